"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` successive k-grams the least hash is kept as a fingerprint, for
benchmark and documents alike, so a shared run of ``window`` words has a fingerprint in
common. Fingerprints are joined and each hit is extended both ways, word by word; longer shared runs
are what the hits of successive fingerprints cover together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, kept, text_of, with_text
from .words import ALNUM, Words, buffers, grams, mix, slices, words

#: Benchmark words that are sent to the executors at once (8 bytes each and as much again for
#: fingerprints); a larger benchmark is taken in several slices, each joined with all documents.
SLICE_WORDS = 2_000_000


def winnow(w: Words, k: int, span: int) -> np.ndarray:
    """Word positions of the fingerprints: in every ``span`` successive k-grams of a text, the rightmost least one."""
    g, whole = grams(w, k)
    n = len(g)
    if n < span:
        return np.empty(0, np.int64)
    best, at = g[: n - span + 1].copy(), np.arange(n - span + 1)
    for j in range(1, span):
        later = g[j : n - span + 1 + j]
        less = later <= best
        best[less] = later[less]
        at[less] = np.flatnonzero(less) + j
    fits = w.room()[: n - span + 1] >= k + span - 1
    return np.unique(at[fits])


def _context(w: Words, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """A hash of the words from ``before`` words ahead of each position to ``after`` from it on, as far as its text goes."""
    text = np.searchsorted(w.first, at, "right") - 1
    first, end = w.first[text], w.first[text + 1]
    out = np.zeros(len(at), np.uint64)
    for j in range(-before, after):
        here = at + j
        inside = (here >= first) & (here < end)
        out = mix(out + np.where(inside, w.hashes[np.where(inside, here, 0)], np.uint64(0x5DEECE66D + j + before)))
    return out


class Benchmark:
    """Word hashes, fingerprints and short items of one slice of the benchmark.

    A fingerprint only decides on the windows that it lies in, so an item's fingerprints whose words around them are
    equal are one entry; and so are a text's when it is compared. Repeats thus cost what one of them does.
    """

    def __init__(self, ids: list, w: Words, window: int, k: int):
        self.ids, self.words, self.window, self.k = ids, w, window, k
        self.span = window - k + 1
        g, _ = grams(w, k)
        at = winnow(w, k, self.span)
        item = np.searchsorted(w.first, at, "right") - 1
        _, one = np.unique(np.stack([item.astype(np.uint64), _context(w, at, self.span - 1, window)]), axis=1, return_index=True)
        at, item = at[one], item[one]
        order = np.argsort(g[at], kind="stable")
        self.prints, self.at, self.item = g[at][order], at[order], item[order]
        #: Items of fewer words than a window, by their number of words: sorted hashes and item numbers.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(w.counts[(w.counts > 0) & (w.counts < window)]).tolist():
            items = np.flatnonzero(w.counts == n)
            h = grams(w, n)[0][w.first[items]]
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], items[order])

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of the texts are in a shared window; and the distinct pairs of a text and an item that share one."""
        n = len(w.hashes)
        steps = np.zeros(n + 1, np.int64)  # begins less ends of the runs
        pairs = []

        def cover(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(steps, begin, 1)
            np.subtract.at(steps, end, 1)

        for size, (prints, items) in self.short.items():
            h, whole = grams(w, size)
            low, high = np.searchsorted(prints, h), np.searchsorted(prints, h, "right")
            at = np.flatnonzero(whole & (high > low))
            if not len(at):
                continue
            cover(at, at + size)
            text = np.searchsorted(w.first, at, "right") - 1
            met = np.unique(np.stack([text, low[at], high[at]]), axis=1)  # a text and the items of one content
            several = met[2] - met[1]
            pairs.append((np.repeat(met[0], several), items[np.repeat(met[1], several) + _ranks(several)]))

        at = winnow(w, self.k, self.span)
        mine = grams(w, self.k)[0][at]
        low, high = np.searchsorted(self.prints, mine), np.searchsorted(self.prints, mine, "right")
        shared = high > low
        at, low, high = at[shared], low[shared], high[shared]
        if len(at):
            text = np.searchsorted(w.first, at, "right") - 1
            _, one, which = np.unique(
                np.stack([text.astype(np.uint64), _context(w, at, self.span - 1, self.window)]), axis=1, return_index=True, return_inverse=True
            )
            before, after = np.full(len(one), -1), np.zeros(len(one), np.int64)
            for a, b in _chunks(high[one] - low[one]):
                several = (high - low)[one[a:b]]
                of = np.repeat(np.arange(a, b), several)
                bench = np.repeat(low[one[a:b]], several) + _ranks(several)
                back, on = self._extended(w, at[one[of]], self.at[bench])
                long = back + on >= self.window
                np.maximum.at(before, of[long], back[long])
                np.maximum.at(after, of[long], on[long])
                pairs.append((text[one[of[long]]], self.item[bench[long]]))
            which = which.ravel()
            long = before[which] >= 0
            cover(at[long] - before[which[long]], at[long] + after[which[long]])
        texts, items = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        texts, items = np.unique(np.stack([texts, items]), axis=1)
        return np.cumsum(steps[:-1]) > 0, texts, items

    def _extended(self, w: Words, doc: np.ndarray, bench: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before and from each pair of positions on agree, as far as a window around the fingerprint goes."""
        its = self.words
        back, on = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        room = np.minimum(w.room()[doc], its.room()[bench])
        ahead = np.minimum(doc - w.first[np.searchsorted(w.first, doc, "right") - 1], bench - its.first[np.searchsorted(its.first, bench, "right") - 1])
        for reach, most, sign, shift in ((on, np.minimum(room, self.window), 1, 0), (back, np.minimum(ahead, self.span - 1), -1, 1)):
            live = np.arange(len(doc))
            while len(live):
                live = live[reach[live] < most[live]]
                step = sign * (reach[live] + shift)
                live = live[w.hashes[doc[live] + step] == its.hashes[bench[live] + step]]
                reach[live] += 1
        return back, on


def _ranks(several: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)


def _chunks(several: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of counts that add up to about ``most``."""
    total, begin = np.cumsum(several), 0
    while begin < len(several):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


_FOUND = "n_words long, items array<string>, hits array<int>"
OUTPUTS = ("doc_id", "n_words", "n_hit", "items", "hits")


def _scan(batches: Iterator[pa.RecordBatch], sent, text: str, window: int, k: int, through: tuple[str, ...], only_hit: bool) -> Iterator[pa.RecordBatch]:
    """The columns ``through`` and what was found of each row, or of the rows that something was found of."""
    ids = [x[0] for x in sent.value]
    bench = Benchmark(ids, words(*buffers(pa.array([x[1] for x in sent.value], pa.string())), ALNUM), window, k)
    for batch in batches:
        texts = text_of(batch, text)
        for a, b in slices(texts):
            w = words(*buffers(texts[a:b]), ALNUM)
            hit, rows, items = bench.hits(w)
            edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            inner = w.first[1:-1]
            inner = inner[(inner > 0) & (inner < len(hit))]
            inner = inner[hit[inner] & hit[inner - 1]]  # a run that goes on into the next text is two
            edge = np.sort(np.concatenate([edge, np.repeat(np.unique(inner), 2)]))
            begin, end = edge[::2], edge[1::2]
            own = np.searchsorted(w.first, begin, "right") - 1
            runs = np.stack([begin - w.first[own], end - w.first[own]], axis=1).astype(np.int32)
            run_at, item_at = np.searchsorted(own, np.arange(b - a + 1)), np.searchsorted(rows, np.arange(b - a + 1))
            hits = pa.ListArray.from_arrays(pa.array(2 * run_at, pa.int32()), pa.array(runs.ravel(), pa.int32()))
            found = [sorted({ids[j] for j in items[x:y].tolist()}, key=lambda s: s.encode()) for x, y in zip(item_at[:-1].tolist(), item_at[1:].tolist(), strict=True)]
            columns = {c: batch.column(c)[a:b] for c in through}
            columns |= {"n_words": pa.array(w.counts, pa.int64()), "items": pa.array(found, pa.list_(pa.string())), "hits": hits}
            out = pa.RecordBatch.from_pydict(columns)
            yield out.filter(pa.array(np.diff(item_at) > 0)) if only_hit else out


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", keep: tuple[str, ...] = (), slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items array<string>, hits array<int>, and ``keep``.

    A benchmark item's windows are its runs of ``window`` words, or all of it where it has fewer (but
    not none); a document word is hit if it is inside an occurrence of a window in the whole text.
    ``items`` are the distinct ids, as strings and sorted, of items with such an occurrence; ``hits`` are
    word numbers, begin and end (exclusive) of each run by turns. Words are runs of ASCII letters (A-Z in lower
    case), digits and all characters beyond ASCII, compared by 64-bit hashes.

    A null text has no words; an item with null or wordless text has no windows; the id of an
    item with a null item_id is the empty string. Repeated rows of either table are kept and count once per item id.
    An empty benchmark leaves every document clean; empty documents give an empty result. A kept column that is named like one of
    these comes out as kept_<name>.

    A benchmark of up to ``slice_words`` words is sent to all tasks. A larger one is dealt into slices by a hash of the item; each is held, sent
    and searched for in all documents by itself, its hits are written down, and those of all slices are joined at the end.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    whole, out = kept(docs, keep, OUTPUTS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *with_text(docs, text, keep), F.xxhash64(F.col(doc_id), body).alias("__row"), whole)
    item = F.col(item_text).cast("string")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), item.alias("text"))
    n_words = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1), F.lit(0))).first()[0]
    n_slices = max(1, ceil(n_words / slice_words))
    field = lambda names: ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def searched(slice_: DataFrame, source: DataFrame, through: tuple[str, ...], only_hit: bool) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast([tuple(r) for r in slice_.toLocalIterator()])  # about slice_words words, or one longer item
        return source.mapInArrow(lambda b: _scan(b, sent, text, window, k, through, only_hit), f"{field(through)}, {_FOUND}"), sent

    if n_slices == 1:
        rows, _ = searched(items, rows, ("doc_id", "__kept"), False)
    else:
        parts = []
        for i in range(n_slices):
            mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_slices)) == i)
            hit, sent = searched(mine, rows, ("doc_id", "__row"), True)
            parts.append(checkpointed(hit.select("doc_id", "__row", "items", "hits").distinct()))
            sent.destroy()
        every = reduce(DataFrame.union, parts).groupBy("doc_id", "__row").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits")
        )  # a row for each slice of a document
        counted, _ = searched(items.limit(0), rows, ("doc_id", "__row", "__kept"), False)
        same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.__row") == F.col("h.__row"))
        none = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<int>)")
        rows = counted.alias("d").join(every.alias("h"), same, "left").select(
            "d.doc_id", "d.__kept", "d.n_words", F.coalesce("h.items", none[0]).alias("items"), F.coalesce(_union(F.col("h.hits")), none[1]).alias("hits")
        )
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)),
        F.lit(0).cast("long"),
        lambda n, i: n + F.get("hits", i + 1) - F.get("hits", i),
    )
    n_hit = F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", "items", "hits", n_hit.alias("n_hit"), *out)


def _union(hits: Column) -> Column:
    """Runs (begin and end by turns, of several slices) as the runs that they cover together."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hits) - 2, F.lit(2)), lambda i: F.struct(F.get(hits, i).alias("a"), F.get(hits, i + 1).alias("b")))
    none = F.expr("cast(array() as array<int>)")

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, run["b"])))
        return F.when((F.size(done) > 0) & (run["a"] <= F.get(done, F.size(done) - 1)), joined).otherwise(F.concat(done, F.array(run["a"], run["b"])))

    return F.when(F.size(hits) > 0, F.aggregate(F.sort_array(runs), none, add))
