"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, and against brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fingerprint, html_blocks, jaccard_join, mixing, quality, queries, quotes, secrets, shared, token_counts, warc
from tessera.llm.oracles import ORACLES
from tessera.llm.words import ALNUM, buffers, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, spans string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, f"s{i % 2}" if i % 3 else None, "x", "y") for i, t in enumerate(texts)], DOCS)


ODD = (None, "", "   \n\t", "a", "one two three four five", "one two three four five", "é " * 3000, "password = hunter22 " * 400)


@pytest.mark.parametrize("name", [n for n in ORACLES if n in queries.QUERIES])
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()
    text = lambda df: sorted(tuple("-" if x is None or x is pd.NA or x != x else str(float(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in df[list(want.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_mixing_edges(spark):
    got = mixing.mix_sources(docs(spark, *ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=3)
    assert mixing.mix_sources(docs(spark, *ODD).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(docs(spark, None, "")).collect()} == {0}


def test_mixing_positions_follow_the_schedule(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix_sources(d, (((0.0, 4.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 4.0))), share=0.5).where("taken > 0")
    by = {r["source"]: r["p"] for r in got.groupBy("source").agg(F.avg("position").alias("p")).collect()}
    assert by["a"] == pytest.approx(1 / 3, abs=0.02) and by["b"] == pytest.approx(2 / 3, abs=0.02)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (2, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "x" * 100_000), (5, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    back = warc.read_archives(spark.read.parquet(str(tmp_path / "w"))).collect()
    assert len(back) == len(rows) and all(r["error"] is None for r in back)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in back) == [
        (0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "revisit", 4), (4, "response", 0), (5, "response", 0),
    ]
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {"<p>é</p>".encode(), b"", b"x" * 100_000, b"only"}
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark.read.schema("archive string, content binary").parquet(str(tmp_path / "e"))).count() == 0


def test_warc_dictionary_and_damage():
    records = [warc.record(str(i), f"http://x/{i}", f"<html>page {i} {random.Random(i).random()}</html>".encode() * 20, None, False) for i in range(300)]
    (archive,) = warc.archives(iter(records), warc.dictionary(records[:20]))
    (single,) = warc.archives(iter(records[:1]), warc.dictionary([]))
    assert single[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(single)) == records[:1]
    for cut in range(1, 40):  # in the dictionary frame and its header
        with pytest.raises(ValueError):
            list(warc.frames(archive[:cut]))
    assert archive[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(archive)) == records
    assert list(warc.frames(b"")) == []
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(archive[:-5]))
    for bad in (records[0].replace(b"Content-Length", b"Content-Size"), records[0][:-4], records[0].replace(b"page 0", b"page 9"), b"nothing"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def brute_classes(texts):
    low = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def test_jaccard_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 6, 12, 60, 300]))] + passage * r.randint(0, 1)
        for _ in range(r.randint(1, 9)):
            edited = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                edited[r.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_classes(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert jaccard_join.jaccard_classes(docs(spark, "a").limit(0)).count() == 0


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_jaccard_shuffles_little_in_many_partitions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard_join, "_BROADCAST_KEYS", broadcast)
    r = random.Random(6)
    texts = [" ".join(f"{r.randrange(36**6):x}" for _ in range(300)) for _ in range(1200)]
    texts += [t + " end" for t in texts[:5]]
    d, before = shared.checkpointed(docs(spark, *texts)), shuffled(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_classes(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: i - 1200 if i >= 1200 else i for i in range(len(texts))}
    assert (shuffled(spark) - before) / sum(map(len, texts)) < 0.75


def test_posts_come_back_as_they_were():
    rng = np.random.default_rng(2)
    for bits in (1, 8, 31, 50, 64):
        for n in (1, 2, 7, 3000):
            values = np.sort(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
            assert (jaccard_join._unrice(jaccard_join._rice(values)) == values).all()


def test_short_keys_that_clash_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "post_widths", lambda *_: (32, 1), raising=False)
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(9)) for _ in range(r.choice([4, 9, 40, 200]))) for _ in range(150)]
    texts += [t + " end" for t in texts]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_classes(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_ids_that_are_null_or_repeat(spark):
    import corpus_pipeline as p

    w = [f"w{i}" for i in range(200)]
    a, b = " ".join(w), " ".join(reversed(w))
    classes = lambda d: sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(d).collect()), key=str)
    stay = lambda d: sorted(((r["doc_id"], r["text"]) for r in p.keep_one_of_each(spark, d, "").collect()), key=str)
    chain = rows_of(spark, (1, a), (None, " ".join(w[:170])), (3, " ".join(w[:140])))
    assert classes(chain) == [(1, 1), (3, 1), (None, 1)] and stay(chain) == [(1, a)]
    shared = rows_of(spark, (5, a), (4, a), (5, b))
    assert classes(shared) == [(4, 4), (5, 4), (5, 5)] and stay(shared) == [(4, a), (5, b)]
    again = rows_of(spark, (9, a), (9, a), (None, b), (None, b), (None, None), (9, ""), (9, ""), (9, a + " x"))
    assert stay(again) in [sorted([(9, ""), (9, ""), (9, t), (None, None), (None, b)], key=str) for t in (a, a + " x")]
    r = random.Random(9)
    texts = [" ".join(w[r.randrange(3) : 190 + r.randrange(10)]) if r.random() < 0.5 else " ".join(r.choice(w) for _ in range(30)) for _ in range(60)]
    ids = [r.choice([None, *range(20)]) for _ in texts]
    roots = [x for _, x in brute_classes(texts)]
    least = {root: min((i for i, x in zip(ids, roots, strict=True) if x == root and i is not None), default=None) for root in roots}
    d = rows_of(spark, *zip(ids, texts, strict=True))
    assert classes(d) == sorted(((i, least[x]) for i, x in zip(ids, roots, strict=True)), key=str)
    assert len(stay(d)) == len(set(roots)) and {i for i, _ in stay(d)} == set(least.values())


def test_rows_without_many_others_are_not_all_shuffled(spark):
    import corpus_pipeline as p

    long = " ".join(f"{random.Random(i).randrange(36**6):x}" for i in range(300))
    rows = shared.checkpointed(rows_of(spark, *((i if i % 7 else None, f"{i} {long}") for i in range(500)), (3, "again"), (None, None)).withColumn("row_key", jaccard_join.row_keys(F.col("doc_id"), F.col("text"))))
    gone = shared.checkpointed(rows.where("text like '1_ %' or text is null").select("doc_id", "row_key"))
    plain = {(r["doc_id"], r["text"]) for r in rows.where("text is not null and not text like '1_ %'").collect()}
    before = shuffled(spark)
    got = [(r["doc_id"], r["text"]) for r in p._without(rows, gone, 0).collect()]
    assert len(got) == len(plain) == 491 and set(got) == plain
    assert shuffled(spark) - before < 500 * len(long) // 10


def test_merge_skip():
    r = random.Random(8)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(0, 12))) for _ in range(r.randint(1, 9))]
        flat = [x for y in lists for x in y]
        stop = np.cumsum([len(y) for y in lists]).tolist()
        need = r.randint(1, 5)
        ids, count = jaccard_join.merge_skip(flat, [0, *stop[:-1]], stop, need)
        assert dict(zip(ids.tolist(), count.tolist(), strict=True)) == {x: flat.count(x) for x in set(flat) if flat.count(x) >= need}


def test_signatures_and_search_lose_nothing():
    rng, r = np.random.default_rng(3), random.Random(4)
    words = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for _ in range(150):
        n = r.choice([1, 2, 3, 5, 8, 13, 30, 120, 400])
        base = np.unique(rng.choice(words, n, replace=False))
        sets = [base] + [np.unique(np.concatenate([rng.choice(base, max(1, len(base) - r.randint(0, max(1, n // 6))), replace=False), rng.choice(words, r.randint(0, max(1, n // 8)))])) for _ in range(5)]
        common = np.sort(rng.choice(base, r.choice([0, n // 3, n]), replace=False))
        sig, own = jaccard_join.signatures(sets, jaccard_join.Bands(4, 5), common)
        posts = [set(sig[own == i].tolist()) for i in range(len(sets))]
        a, b = jaccard_join.search(sets, 4, 5)
        root = list(range(len(sets)))
        for x, y in zip(a, b, strict=True):
            p, q = root[x], root[y]
            root = [p if z == q else z for z in root]
        for i in range(len(sets)):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                    assert posts[i] & posts[j] and root[i] == root[j]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in shared.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_fingerprints_edges(spark):
    texts = [*ODD, "A sentence here. " * 300, "Another one, quite. " * 300, "One short text of a few words only."]
    texts += [f"{texts[-1][:26]} and another end", *(" ".join(f"word{i * j % 97}" for j in range(i)) for i in range(2, 400, 13))]
    d = fingerprint.with_next(docs(spark, *texts), carry={"a": fingerprint.paragraphs(F.col("text")), "sa": fingerprint.sketch("a")}, ranges=5)
    d = d.withColumns({"f": fingerprint.fingerprint("sa"), "g": fingerprint.fingerprint("next_sa"), "d": fingerprint.differing("sa", "next_sa")})
    d = d.withColumns({"pa": fingerprint.parsed("f"), "pb": fingerprint.parsed("g")}).withColumn("dp", fingerprint.differing("pa", "pb"))
    d = d.withColumns({"like": fingerprint.likeness("sa", "next_sa", "d"), "again": fingerprint.likeness("pa", "pb", "dp")})
    got = {r["doc_id"]: r for r in d.collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r["next"] == (texts[(i + 1) % len(texts)] or "")
        a, b = set(r["a"]), set(r["next_a"])
        assert set(r["sa"]["listed"]) == a and set(r["pa"]["listed"]) == a and r["f"] == r["f"].strip()
        assert set(r["d"]["a"]) == a - b and set(r["d"]["b"]) == b - a
        assert r["like"] == r["again"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1)  # what is stored tells as much
    assert got[4]["f"] == got[5]["f"] and got[4]["like"] == 1 and got[0]["f"] == ""
    assert 0 < got[len(ODD) + 2]["like"] < 1
    assert fingerprint.with_next(docs(spark, "a").limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, f"t{i}") for i in range(30)] + [(7, "seven"), (7, "seven"), (9, None)], "doc_id long, text string")
    follows = {r["text"]: r["next"] for r in fingerprint.with_next(nulls).collect()}
    at, seen = "", []
    for _ in range(31):
        at = follows[at]
        seen.append(at)
    assert len(set(seen)) == 31 and follows[""] in seen and "seven" in seen  # one round through all texts
    with pytest.raises(TypeError):
        fingerprint.with_next(nulls.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, labels)
    got = quality.quality_scores(d, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95
    odd = quality.quality_scores(docs(spark, *ODD), model, keep=("text", "source")).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    blank = quality.fit(d, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(docs(spark, "a", None), blank).collect()} == {0.5}


def test_quality_is_the_plain_algorithm(spark):
    """Feature hashes, training and scores in plain loops over whole numbers and floats."""
    from tessera.llm import words as h

    full, letters = (1 << 64) - 1, [int(x) for x in h._LETTERS]

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def word(w):
        return mix(sum(letters[b] * pow(h._BASE, j, 1 << 64) for j, b in enumerate(w)) + len(w) & full)

    def shape(w):
        kinds = [48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in w]
        kinds = [k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
        return mix(sum(mix(k * h._BASE + j & full) for j, k in enumerate(kinds)) & full)

    def features(text):
        ws = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        out = []
        for salt, of in ((1, word), (2, shape)):
            one = [of(w) for w in ws]
            out += [mix(x + salt & full) for x in one] + [mix(a * h._BASE + b + salt + 2 & full) for a, b in zip(one, one[1:], strict=False)]
        return [x >> 46 for x in out + [mix(7)] * sum(a == b for a, b in zip(ws, ws[1:], strict=False))]

    texts = ["Good plain text here.", "BUY now now now!!! $$$", "", None, "Ünïcode words 12 a1B2", "one one two", "Another good sentence, quite plain."] * 3
    labels = [1, 0, 0, 1, 1, 0, 1] * 3
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.fit(d, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))
    import hashlib
    import zlib

    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = sorted(used, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    z, n = {}, {}

    def weight(k):
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= 0.02 else ((0.02 if x > 0 else -0.02) - x) / (1.0 + n.get(k, 0.0) ** 0.5 + 0.5)

    rng = np.random.default_rng(5)
    for _ in range(4):
        for j in rng.permutation(len(order)):
            fs = features(texts[order[j]])
            x = {k: float(np.float32(fs.count(k) / max(len(fs), 1) ** 0.5)) for k in set(fs)} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - labels[order[j]]) * x[k]
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) * w[k]
                n[k] = n.get(k, 0.0) + g * g
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, got).collect()}
    for i, t in enumerate(texts):
        fs = features(t)
        want = 1 / (1 + np.exp(-(weight("bias") + sum(weight(k) for k in fs) / max(len(fs), 1) ** 0.5)))
        assert scores[i] == pytest.approx(want, abs=1e-5)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Bob wrote:\n> how ARE you\nFine."), (1, 2, "user", ">> How are you?\n> Fine.\nGood!"),
        (1, 3, "user", "> never said\nOdd"), (1, None, "user", "> Fine."), (2, 0, None, None), (2, 1, "user", "> Fine.\n"), (1, 1, "assistant", "> Hello there\nFine."), (None, 0, "user", "Fine."), (None, 1, "user", "> Fine."),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    every = quotes.link_quotations(m).collect()
    assert len(every) == len(rows) and [r["position"] for r in every] == list(range(len(rows)))
    got = {(r["conv_id"], r["turn"]): r for r in every}
    assert (got[1, 1]["parent"], got[1, 1]["reply"], got[1, 1]["root"], got[1, 1]["depth"]) == (0, "Fine.", 0, 1)
    assert (got[1, 2]["parent"], got[1, 2]["root"], got[1, 2]["depth"], got[1, 2]["max_level"], got[1, 2]["n_linked"]) == (1, 0, 2, 2, 2)
    assert (got[1, 3]["parent"], got[1, 3]["n_quoted"], got[1, 3]["n_linked"], got[2, 1]["parent"]) == (None, 1, 0, None)
    assert (got[None, 1]["parent"], got[1, None]["n_quoted"]) == (0, 0)
    assert quotes.link_quotations(m.limit(0)).count() == 0


def test_quotations_wrapped_anew_and_deep(spark):
    told = "The quick brown fox jumps over the lazy dog near the river. It then goes to sleep under a tree and dreams of hens"
    rows = [(1, 0, "user", told)]
    for i in range(1, 6):  # each answers the one before, wrapped anew, under a long line that announces it
        before = told if i == 1 else f"Answer number {i - 1} has quite a few words that somebody may well wrap in another place"
        wrapped = "\n> ".join(" ".join(before.split()[j : j + 3 + i]) for j in range(0, len(before.split()), 3 + i))
        rows.append((1, i, "user", f"{'On a day of which much could be said ' * 20}somebody wrote:\n> {wrapped}\nAnswer number {i} has quite a few words\nthat somebody may well wrap in another place"))
    rows.append((1, 6, "user", "Unrelated"))
    rows.append((1, 7, "user", "> It then goes to sleep under a\n> tree and dreams of hens\n>\n> Unrelated\nBoth"))
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {r["turn"]: r for r in got}
    assert [(by[i]["parent"], by[i]["root"], by[i]["depth"]) for i in range(1, 6)] == [(i - 1, 0, i) for i in range(1, 6)]
    assert all(by[i]["reply"].startswith("Answer number") for i in range(1, 6)) and (by[7]["parent"], by[7]["n_linked"]) == (6, 2)
    assert [r["turn"] for r in got] == [0, 1, 2, 3, 4, 5, 6, 7]


def test_winnowing_edges(spark):
    ws = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(ws[:25])), (2, "short Item"), (3, None), (None, " ".join(ws[30:45])), (1, " ".join(ws[:25]))], "item_id long, text string")
    texts = [*ODD, "x " + " ".join(ws[5:15]) + " y", " ".join(ws[5:14]), "a SHORT item b short", " ".join(ws) * 2]
    for size in (2_000_000, 20):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, *texts), items, keep=("text", "spans"), slice_words=size).collect()}
        n = len(ODD)
        assert [(got[n + i]["n_hit"], got[n + i]["items"]) for i in range(3)] == [(10, ["1"]), (0, []), (2, ["2"])]
        assert all(got[i]["n_hit"] == 0 for i in range(n)) and got[n + 3]["items"] == ["", "1"] and got[n + 3]["text"] == texts[-1]
    assert decontaminate.contamination(docs(spark, *texts), items.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_repeats():
    r = random.Random(1)
    made = lambda n: " ".join(r.choice("abcd"[: r.choice([2, 4])]) for _ in range(n))
    split = lambda texts: words(*buffers(pa.array(texts)), ALNUM)
    for _ in range(60):
        items = [made(r.choice([0, 3, 9, 10, 11, 14, 40])) for _ in range(5)] + ["a " * 30]
        texts = [f"{made(r.choice([0, 5, 10, 60]))} {r.choice(items)} {made(r.choice([0, 8, 30]))}" for _ in range(4)] + ["a " * r.choice([9, 10, 40])]
        w = split(texts)
        hit, row, item = decontaminate.Benchmark(list(range(len(items))), split(items), 10, 5).hits(w)
        for i, t in enumerate(texts):
            ws, want, its = t.split(), set(), set()
            for j, x in enumerate(items):
                n = min(10, len(x.split()))
                grams = {tuple(x.split()[k : k + n]) for k in range(len(x.split()) - n + 1)} if n else set()
                at = [k for k in range(len(ws) - n + 1) if tuple(ws[k : k + n]) in grams]
                its |= {j} if at else set()
                want |= {k + m for k in at for m in range(n)}
            assert set(np.flatnonzero(hit[w.first[i] : w.first[i + 1]]).tolist()) == want and set(item[row == i].tolist()) == its
    began = time.time()
    hit, _, item = decontaminate.Benchmark(["1"], split(["a " * 5000]), 10, 5).hits(split(["a " * 20_000]))
    assert hit.all() and len(hit) == 20_000 and item.tolist() == [0] and time.time() - began < 5


def test_kept_columns_may_clash(spark):
    names = ["key", "run", "items", "n_words", "spans", "score", "position", "kept_score", "size", "doc_id", "text"]
    d = spark.createDataFrame([(1, "a b", "s", *"cdefghijk")], ["doc_id", "text", "source", *[n for n in names if n not in ("doc_id", "text")]])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for size in (10, 1):
        r = decontaminate.contamination(d, items, keep=tuple(names), slice_words=size).first().asDict()
        assert (r["n_hit"], r["items"], r["kept_items"], r["kept_n_words"], r["key"], r["kept_doc_id"], r["text"]) == (2, ["1"], "e", "f", "c", 1, "a b")
    r = mixing.mix_sources(d, keep=names).first().asDict()
    assert (r["size"], r["key"], r["run"], r["kept_position"], r["kept_size"]) == (2, "c", "d", "i", "k")
    assert secrets.secret_spans(d, keep=tuple(names)).first().asDict()["kept_spans"] == "g"
    r = quality.quality_scores(d, quality.train(quality.Examples(*[np.empty(0, np.int64)] * 4)), keep=tuple(names)).first().asDict()
    assert (r["score"], r["kept_kept_score"], r["kept_score"]) == (0.5, "h", "j") or (r["score"], r["kept_score"]) == (0.5, "j")
    assert token_counts.token_counts(d, queries.VOCABULARY, keep=("n_words", "items")).first().asDict()["kept_n_words"] == "f"


def test_mixing_schedule_of_several_segments(spark):
    schedule = ((0.0, 1.0), (0.25, 4.0), (0.5, 0.0), (1.0, 2.0))
    d = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w x y "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    got = sorted(mixing.mix_sources(d, (schedule,), share=1.5).where("position is not null").collect(), key=lambda r: r["position"])
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))

    def demand(t):  # by small steps
        total, n = 0.0, 2000
        for i in range(int(t * n)):
            x = (i + 0.5) / n
            a, b = next((a, b) for a, b in zip(schedule, schedule[1:], strict=False) if a[0] <= x <= b[0])
            total += (a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0])) / n
        return total / area

    assert len(got) == 300 and sum(r["taken"] for r in got) == 1800
    for i in range(0, 300, 37):
        assert demand(got[i]["position"]) == pytest.approx(4 * i / 1800, abs=0.005)
    assert sum(r["last_position"] > r["position"] for r in got) == 150


def test_warc_of_others():
    uuid = "<urn:uuid:f47ac10b-58cc-4372-a567-0e02b2c3d479>"

    def made(kind, block, **more):
        lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: {uuid}", "WARC-Date: 2024-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = {"Content_Type": "application/http;msgtype=response"}
    assert warc.parse(made("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields")) is None
    assert warc.parse(made("request", b"GET / HTTP/1.1\r\n\r\n", **http)) is None and warc.parse(made("metadata", b"")) is None
    r = warc.parse(made("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", WARC_Target_URI="http://x/", WARC_Payload_Digest=f"sha1:{warc.digest(b'body')}", X="a\r\n  folded", **http))
    assert (r["payload"], r["record_id"], r["page_id"], r["url"]) == (b"body", uuid.strip("<>"), None, "http://x/")
    assert warc.parse(made("response", b"1.2.3.4", Content_Type="text/dns"))["payload"] == b"1.2.3.4"
    r = warc.parse(made("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha1:" + "A" * 32, WARC_Refers_To=uuid, **http))
    assert (r["payload_bytes"], r["refers_to_record"], r["payload_digest"]) == (None, uuid.strip("<>"), "A" * 32)
    for bad in (made("response", b"no http", **http), made("response", b"HTTP/1.1 200\r\n\r\nx", WARC_Payload_Digest="sha1:" + "B" * 32, **http), made("revisit", b"", **http), made("request", b"x")[:-1]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_ids_of_text_and_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([("a/b é", "u", "x"), ("c", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    back = {r["page_id"]: r for r in warc.read_archives(spark.read.parquet(str(tmp_path / "w")), id_type="string").collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in back.items()} == {"c": ("response", None), "a/b é": ("revisit", "c"), None: ("response", None)}
    (archive,) = warc.archives(iter([warc.record("1", None, b"x", None, False)]), warc.dictionary([]))
    broken = spark.createDataFrame([(archive[:6],), (archive[:-2],), (archive,), (b"??",), (None,)], "content binary")
    assert sorted(r["error"] is None for r in warc.read_archives(broken).collect()) == [False, False, False, True]


def test_secrets_many_in_one_text(spark):
    text = " ".join(f"user=bob{i} token = abc{i:06d} https://h{i}.example.com/p" for i in range(4000))
    began = time.time()
    r = secrets.secret_spans(docs(spark, text, text)).collect()
    assert [len(x["spans"]) for x in r] == [12_000, 12_000] and time.time() - began < 60


def test_secrets_link_and_redact(spark):
    token = "Zx81" * 8
    texts = [*ODD, f"client_id: bob42 and then {token}", f"only {token}", "é AKIA" + "A" * 16 + f" https://api.example.com/x {token} ", token + " " * 400 + " user=bob"]
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs(spark, *texts), keep=("text", "source", "size")).withColumn("t", secrets.spans_text(F.col("spans"))).withColumn("r", secrets.redacted(F.col("text"), F.col("spans"))).collect()}
    n = len(ODD)
    assert got[n]["t"] == f"login:0:16,loose:26:{26 + len(token)}" and got[n + 1]["t"] == "" and got[n + 3]["t"] == ""
    assert got[n + 2]["t"].startswith("access:2:22,endpoint:23:") and got[n + 2]["r"].startswith("é [REDACTED] [REDACTED] [REDACTED]")
    assert got[n - 1]["t"].count("assign") == 400 and got[0]["r"] is None and got[1]["r"] == ""


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1><p>First  para<br>graph.<p>Second one, with more words.</article><footer>&copy; x</footer><script>'</p>'</script>"
    d = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p unclosed"), (1, "u", page)], "page_id long, url string, html string")
    got = [tuple(r) for r in html_blocks.extract_main_text(d).select("page_id", "text").collect()]
    assert got.count((1, "Head & tail\n\nFirst para graph.\n\nSecond one, with more words.")) == 2 and (2, "") in got and (3, "") in got and len(got) == 5
    rng, right, n = np.random.default_rng(77), 0, 0
    for _ in range(60):
        html, main = html_blocks.made_up_page(rng)
        bs = html_blocks.blocks(html)
        if bs:
            score = html_blocks.trained().score([html_blocks.read(bs)])[0]
            even = {" ".join(__import__("html").unescape(x).split()) for x in main}
            right, n = right + sum((s >= 0.5) == (b.text in even) for b, s in zip(bs, score, strict=True)), n + len(bs)
    assert right / n > 0.98


def test_labeller_is_the_plain_network():
    """Block by block in plain loops, forth and back."""
    rng = np.random.default_rng(4)
    model = html_blocks.trained()
    sizes = html_blocks.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    for _ in range(3):
        page = html_blocks.read(html_blocks.blocks(html_blocks.made_up_page(rng)[0]))
        inputs, path_at, word_at = [], 0, 0
        for i, (p, w) in enumerate(zip(page.n_paths, page.n_words, strict=True)):
            mean = lambda table, ids: np.mean([table[j] for j in ids], axis=0) if len(ids) else np.zeros(table.shape[1])
            inputs.append(np.concatenate([mean(model.p["paths"], page.paths[path_at : path_at + p]), mean(model.p["words"], page.words[word_at : word_at + w]), page.figures[i]]))
            path_at, word_at = path_at + p, word_at + w
        states = {}
        for d in "fb":
            h, c, out = np.zeros(sizes), np.zeros(sizes), {}
            for t in range(len(inputs)) if d == "f" else range(len(inputs) - 1, -1, -1):
                z = inputs[t] @ model.p[f"x{d}"] + h @ model.p[f"h{d}"] + model.p[f"c{d}"]
                c = sig(z[sizes : 2 * sizes]) * c + sig(z[:sizes]) * np.tanh(z[3 * sizes :])
                h = sig(z[2 * sizes : 3 * sizes]) * np.tanh(c)
                out[t] = h
            states[d] = out
        want = [sig(np.concatenate([states["f"][t], states["b"][t]]) @ model.p["out"][:, 0] + model.p["bias"][0]) for t in range(len(inputs))]
        assert model.score([page])[0] == pytest.approx(want, abs=1e-4)


def test_main_text_of_all_pages(spark):
    """Against another reader: what the pages have in their articles, by tag, without what is named as menu, advert, notice or comment."""
    from html.parser import HTMLParser

    apart = {"p", "h1", "h2", "h3", "h4", "li", "div", "article", "section", "blockquote", "pre", "td", "ul", "ol", "table", "tr"}
    odd = re.compile(r"\b(nav|menu|footer|sidebar|side|ad|ads|advert|cookie|banner|comment|comments|related|share|promo|breadcrumb)s?\b")

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.now = [], [], ""

        def end(self):
            said = " ".join(self.now.split())
            bad = any(t in ("nav", "footer", "aside", "script", "style", "head", "form", "header") or odd.search(c) for t, c in self.stack)
            if said and not bad:
                self.blocks.append(said)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in apart or tag in ("nav", "footer", "aside", "script", "style", "head", "form", "header", "body"):
                self.end()
            if tag == "br":
                self.now += " "
            if tag not in ("br", "meta", "img", "link", "hr", "input", "p", "li"):
                self.stack.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id"))))

        def handle_endtag(self, tag):
            if tag in apart or tag in ("nav", "footer", "aside", "script", "style", "head", "form", "header", "body"):
                self.end()
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.now += data

    same = n = 0
    for r in queries.op9_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        reader = Reader()
        reader.feed(r["html"])
        reader.close()
        reader.end()
        got, want = set(r["text"].split("\n\n")), set(reader.blocks)
        same, n = same + len(got & want), n + len(got | want)
    assert same / n > 0.97, (same, n)


def test_labeller_gradient():
    rng = np.random.default_rng(1)
    pages = [html_blocks.read(html_blocks.blocks(html_blocks.made_up_page(rng)[0])) for _ in range(3)]
    labels = [rng.integers(0, 2, len(p.n_words)).astype(np.float32) for p in pages]
    model = html_blocks.Labeller()
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    _, g = model.gradient(pages, labels)
    for name in ("hf", "xb", "out", "cf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (1e-3, -2e-3):
            model.p[name][at] += step
            losses.append(model.gradient(pages, labels)[0])
        model.p[name][at] += 1e-3
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_longest_match_automaton():
    r = random.Random(2)
    for _ in range(60):
        make = lambda: {"".join(r.choice("abc") for _ in range(r.randint(1, 5))).encode() for _ in range(r.randint(1, 12))}
        first, rest = make(), make()
        a = token_counts.LongestMatch(first, rest)
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(0, 12))).encode()
            assert a.count(word) == greedy(word, first, rest)


def test_token_counts(spark, tmp_path):
    (tmp_path / "v.txt").write_text("un\n##aff\n##able\nable\n!\n")
    got = [tuple(r)[1:] for r in token_counts.token_counts(docs(spark, None, "", "Unaffable able! zzz", "un un un"), str(tmp_path / "v.txt")).orderBy("doc_id").collect()]
    assert got == [(0, 0), (0, 0), (4, 6), (3, 3)]
    first, rest = map(set, token_counts.load_pieces(queries.VOCABULARY))
    text = pd.read_parquet(f"{SF}/documents.parquet").text[3]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    want = sum(greedy(w.encode(), first, rest) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]", low))
    assert token_counts.token_counts(docs(spark, text), queries.VOCABULARY).first()["n_tokens"] == want


def test_pipeline(spark):
    import corpus_pipeline as p

    docs_, path = spark.read.parquet(f"{SF}/documents.parquet"), SF
    kept = docs_
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, path)
        assert out.columns == p.COLUMNS, name
        assert stage(spark, docs_.limit(0), path).count() == 0
        kept = spark.createDataFrame(out.toPandas(), docs_.schema)
    ids = {r["doc_id"] for r in kept.collect()}
    assert 0 < len(ids) < docs_.count()
    got = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == ids and len(got) == len(ids)
    # by brute force: of what the classifier keeps, the least of each class without a benchmark window
    first = p.keep_good(spark, docs_, SF).orderBy("doc_id").toPandas()
    classes = brute_classes(list(first.text))
    least = [i for i, (n, r) in enumerate(classes) if r == i or not n]
    hits = {r["doc_id"] for r in decontaminate.contamination(docs_, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert ids == {int(first.doc_id[i]) for i in least} - hits
    assert not secrets.secret_spans(kept).where(F.exists("spans", lambda s: s["kind"] == 1)).count()
