"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, text_of, with_text
from .words import _BASE, SPACED, Words, buffers, mix, slices, words

#: Labelled rows that training takes at most: those whose MD5 of the doc_id is least, whatever the size of the tables.
TRAIN_ROWS = 6000
BITS = 18

# A byte's class for the shape of a word: letters of either case, digits and the rest beyond ASCII by class, marks as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def shapes(data: np.ndarray, w: Words) -> np.ndarray:
    """A hash of each word's shape: its byte classes with repeats taken once."""
    if not len(w.hashes):
        return np.empty(0, np.uint64)
    kind = _CLASS[data]
    size = w.ends - w.starts
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - w.starts, size)
    value = kind[at]
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[first] = True
    place = np.cumsum(fresh)
    step = (place - np.repeat(place[first], size)).astype(np.uint64)  # place among the word's fresh classes
    term = mix(value.astype(np.uint64) * np.uint64(_BASE) + step) * fresh
    return mix(np.add.reduceat(term, first))


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: feature numbers, the text of each, and each text's number of words.

    One- and two-word runs of words as they are written and of word shapes, and one number
    for every two-word run that repeats a word.
    """
    w = words(data, at, SPACED, lower=False)
    n = len(w.hashes)
    own = np.repeat(np.arange(len(at) - 1), w.counts)
    shape = shapes(data, w)
    pair = w.room() >= 2
    ids, owners = [], []
    for salt, h in ((1, w.hashes), (2, shape)):
        two = np.zeros(n, np.uint64)
        two[:-1] = h[:-1] * np.uint64(_BASE) + h[1:]
        ids += [mix(h + np.uint64(salt)), mix(two[pair] + np.uint64(salt + 2))]
        owners += [own, own[pair]]
    again = np.flatnonzero(pair[:-1] & (w.hashes[1:] == w.hashes[:-1])) if n else np.empty(0, np.int64)
    ids.append(mix(np.full(len(again), 7, np.uint64)))
    owners.append(own[again])
    every = (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int32)
    return every, np.concatenate(owners), w.counts


@dataclass
class Model:
    """Weights by feature and a bias; a text's score is sigmoid(bias + sum of weights / square root of features)."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a, b in slices(texts):
            ids, own, _ = features(*buffers(texts[a:b]))
            total = np.bincount(own, self.weights[ids], b - a)
            n = np.bincount(own, minlength=b - a)
            z = self.bias + total / np.sqrt(np.maximum(n, 1))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


@dataclass
class Examples:
    """Features, values and labels of all examples, end to end; ``stop`` is where each ends."""

    at: np.ndarray
    value: np.ndarray
    stop: np.ndarray
    label: np.ndarray


def train(examples: Examples, passes: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Follow-the-regularised-leader (proximal, per-coordinate rates) over the examples in a fixed random order."""
    size = (1 << BITS) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(5)

    def weights(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= l1
        return np.where(small, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    begin = np.concatenate([[0], examples.stop[:-1]]).astype(int)
    for _ in range(passes):
        for i in rng.permutation(len(examples.label)):
            at, value = examples.at[begin[i] : examples.stop[i]], examples.value[begin[i] : examples.stop[i]].astype(float)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - examples.label[i]) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def example(ids: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, int]:
    at, count = np.unique(ids, return_counts=True)
    value = count / np.sqrt(max(len(ids), 1))
    return np.append(at, 1 << BITS).astype(np.int64), np.append(value, 1.0), label


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = TRAIN_ROWS, **how) -> Model:
    """Learn from at most ``most`` labelled rows that are not held out.

    Null ids and labels are left out; of several labels of an id the least counts; of several documents of an id all do.
    Without any labelled row the model scores 0.5 everywhere.
    """
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most ``most`` ids

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, _ = features(*buffers(batch.column("text")[i : i + 1]))
                at, value, _ = example(ids, 0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[i : i + 1],
                        "label": batch.column("label")[i : i + 1],
                        "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                        "value": pa.array([value.astype(np.float32).tobytes()], pa.binary()),
                    }
                )

    id_type = docs.schema[doc_id].dataType.simpleString()
    found = rows.mapInArrow(featured, f"doc_id {id_type}, label int, at binary, value binary")
    found = found.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "at").limit(most).select("label", "at", "value")
    at, value, stop, label_ = bytearray(), bytearray(), [], []
    for r in found.toLocalIterator():  # at most ``most`` rows, kept end to end
        at += r["at"]
        value += r["value"]
        stop.append(len(at) // 4)
        label_.append(r["label"])
    return train(Examples(np.frombuffer(at, np.int32), np.frombuffer(value, np.float32), np.array(stop, np.int64), np.array(label_)), **how)


def quality_scores(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score double (0 to 1, higher is better), and ``keep``, one row per row of ``docs``.

    The whole text is scored, in one pass without a shuffle. A null or empty text has the model's bias as its score;
    repeated rows score alike; an empty table gives an empty result. A kept column named doc_id or score comes out as kept_doc_id or kept_score.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights of 4 bytes
    whole, out = kept(docs, keep, ("doc_id", "score"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *with_text(docs, text, keep), whole)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(sent.value.score(text_of(batch, text)), pa.float64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score, "__kept": batch.column("__kept")})

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(scored, f"doc_id {types['doc_id']}, score double, __kept {types['__kept']}").select("doc_id", "score", *out)
