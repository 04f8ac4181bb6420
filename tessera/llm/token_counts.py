"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Where a node has no edge for a character, its failure link leads to the node of what is
left after the longest pieces have been taken off, and the number of pieces taken is stored with the link; so
a word is counted in one pass over its characters, without making the pieces.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept
from .words import ALNUM, buffers, slices, words

#: Bytes that begin no word by themselves and are no white space: each is a word of its own.
_MARK = ~ALNUM
_MARK[[9, 10, 11, 12, 13, 32]] = False
#: Counts of so many different words are remembered by each worker.
CACHE = 200_000


class LongestMatch:
    """Counts greedy longest-match pieces of words: ``first`` pieces begin a word, ``rest`` pieces go on with it.

    A word that can't be made of pieces counts as one unknown token.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # 0: a word's begin, 1: after a piece
        self.ends: list[bool] = [False, True]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self._link()

    def _add(self, root: int, piece: bytes) -> None:
        at = root
        for c in piece:
            nxt = self.edges[at].get(c)
            if nxt is None:
                nxt = len(self.edges)
                self.edges[at][c] = nxt
                self.edges.append({})
                self.ends.append(False)
                self.fail.append(-1)
                self.popped.append(0)
            at = nxt
        self.ends[at] = True

    def _link(self) -> None:
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                queue.append(v)
                if self.ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                at, popped = self.fail[u], self.popped[u]
                while at >= 0 and c not in self.edges[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.edges[at][c], popped

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        at, n = 0, 0
        for c in word:
            while (nxt := self.edges[at].get(c)) is None:
                n += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return 1
            at = nxt
        while at != 1:  # what is left must be made of whole pieces
            n += self.popped[at]
            at = self.fail[at]
            if at < 0:
                return 1
        return n


def load_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-begin and word-inner pieces of a vocabulary file, in UTF-8 and lower case.

    Read as public formats have it: a ``.tiktoken`` rank file or a tokenizers ``.json`` whose pieces after a space begin
    with a space (byte-level, shown as Ġ), or a plain list with ## before inner pieces. Pieces with a byte other than of a word are left out.
    """
    raw: list[bytes] = []
    if path.endswith(".tiktoken"):
        raw = [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]
    elif path.endswith(".json"):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        for piece in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
            if all(c in table for c in piece):
                raw.append(bytes(table[c] for c in piece))
    else:
        lines = [line.rstrip("\n") for line in open(path, encoding="utf-8")]
        return [x.encode() for x in lines if not x.startswith("##")], [x[2:].encode() for x in lines if x.startswith("##")]
    fits = lambda x: x and all(ALNUM[b] for b in x) or len(x) == 1
    first = {x[1:].lower() for x in raw if x.startswith(b" ") and fits(x[1:])}
    rest = {x.lower() for x in raw if fits(x)}
    return sorted(first | rest), sorted(rest)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_tokens (longs) of each whole text, and ``keep``; one row per row of ``docs``.

    A word is a run of ASCII letters, digits and characters beyond ASCII, A-Z in lower case, or any other single
    character that is not white space. Each word is greedily cut into the longest pieces of the vocabulary; one that can't be is
    one token. A null or empty text has none. Repeated rows count alike; an empty table gives an empty
    result. ``vocabulary`` is read on the driver; the automaton is built there and sent out once: its size goes with the file's. A
    kept column that is named like one of these comes out as kept_<name>.
    """
    sent = docs.sparkSession.sparkContext.broadcast(LongestMatch(*load_pieces(vocabulary)))
    whole, out = kept(docs, keep, ("doc_id", "n_words", "n_tokens"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"), whole)
    names = ["doc_id", "__kept"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        known: dict[int, int] = {}
        marks = np.array([automaton.count(bytes([b])) for b in range(256)])
        for batch in batches:
            texts = batch.column("__text")
            for a, b in slices(texts):
                data, at = buffers(texts[a:b])
                w = words(data, at, ALNUM)
                hashes, first, of = np.unique(w.hashes, return_index=True, return_inverse=True)
                if len(known) > CACHE:
                    known.clear()
                each = np.empty(len(hashes), np.int64)
                for i, (h, s, e) in enumerate(zip(hashes.tolist(), w.starts[first].tolist(), w.ends[first].tolist(), strict=True)):
                    n = known.get(h)
                    if n is None:
                        n = known[h] = automaton.count(data[s:e].tobytes().lower())
                    each[i] = n
                total = np.concatenate([[0], np.cumsum(each[of])])
                mark = np.concatenate([[0], np.cumsum(np.where(_MARK[data], marks[data], 0))])
                count = np.concatenate([[0], np.cumsum(_MARK[data])])
                n_tokens = total[w.first[1:]] - total[w.first[:-1]] + mark[at[1:]] - mark[at[:-1]]
                n_words = w.counts + count[at[1:]] - count[at[:-1]]
                columns = {c: batch.column(c)[a:b] for c in names}
                yield pa.RecordBatch.from_pydict(columns | {"n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return rows.mapInArrow(counted, f"{fields}, n_words long, n_tokens long").select("doc_id", "n_words", "n_tokens", *out)
