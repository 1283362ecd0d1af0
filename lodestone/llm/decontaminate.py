"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Every benchmark item has a 64-bit SimHash of its words. A document's windows of an item's size are
fingerprinted the same way, and eight 8-bit block tables find all items within ``RADIUS`` bits: some
block of such a pair differs in at most RADIUS / 8 bits, and tables list every item under each value
that near. What they find is verified exactly by weighted five-word shingles, whose weights fall with
the number of items that have the shingle; pairs of similarity 0.75 or more are leaks.

A window without any shingle of the benchmark has similarity 0, so only windows that hold one are
fingerprinted; this loses nothing. The benchmark is the query set: it goes to the tasks in blocks of
bounded size, and each block sees all documents.

Defined results: words are lowered (A-Z) and lose ASCII punctuation. Null or empty texts, of documents or
items, match nothing; items of fewer than five words are one shingle; null document ids are reported as
null, repeated ids once per item with the best window. Of equal windows the first counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import SIZE, mix, sequence_hashes, word_hashes

SIMILARITY = 0.75
RADIUS = 15
BLOCKS = 8
#: Items sent to tasks at a time.
ITEMS = 2_000
#: Words of a document that are fingerprinted at a time.
STRETCH = 4_096
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BITS = np.arange(64, dtype=np.uint64)
_FILTER_BITS = 22


def plain_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split() if text else []


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for every bit of every word."""
    bits = (mix(hashes)[:, None] >> _BITS) & np.uint64(1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit values from the sums of signs; a tie counts as 1."""
    return np.packbits(sums >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Benchmark:
    """A block of items, grouped by their number of words."""

    def __init__(self, items: list[tuple[int, bytes]]):
        hashes = [(i, word_hashes(plain_words(t))) for i, t in items]
        self.items = [(i, h) for i, h in hashes if len(h)]
        self.shingles = [Counter(sequence_hashes(h).tolist()) for _, h in self.items]
        seen = Counter(s for c in self.shingles for s in c)
        n = len(self.items)
        self.weights = {s: log(1 + n / k) for s, k in seen.items()}
        self.other = log(1 + n)
        self.short = sorted({len(h) for _, h in self.items if len(h) < SIZE})
        known = np.array(sorted(seen), np.uint64)
        self.known = known
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[known >> np.uint64(64 - _FILTER_BITS)] = True
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(h) for _, h in self.items], np.int64)
        prints = (
            np.array([fingerprints(signs(h).sum(axis=0, dtype=np.int32)[None, :])[0] for _, h in self.items], np.uint64)
        )
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            self.groups.append((size, at, prints[at], self.tables(prints[at])))

    def tables(self, prints: np.ndarray) -> np.ndarray:
        """[block, value, item]: whether the item's block is within the share of the radius of the value."""
        near = RADIUS // BLOCKS
        values = np.arange(256, dtype=np.uint8)
        out = np.zeros((BLOCKS, 256, len(prints)), bool)
        for b in range(BLOCKS):
            own = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8)
            out[b] = np.bitwise_count(values[:, None] ^ own[None, :]) <= near
        return out

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Word positions at which a shingle of the benchmark starts."""
        found = []
        for size in {SIZE, *self.short}:
            if len(h) < size and size != SIZE:
                continue
            s = sequence_hashes(h, size)
            at = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
            if len(at):
                where = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
                found.append(at[self.known[where] == s[at]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def similarity(self, item: int, window: np.ndarray) -> float:
        a, b = self.shingles[item], Counter(sequence_hashes(window).tolist())
        both = either = 0.0
        for s in a.keys() | b.keys():
            w = self.weights.get(s, self.other)
            both += w * min(a[s], b[s])
            either += w * max(a[s], b[s])
        return both / either if either else 0.0

    def leaks(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item index to (similarity, first word, words) of its best window in a document."""
        best: dict[int, tuple[float, int, int]] = {}
        if not len(h) or not self.items:
            return best
        hits = self.hits(h)
        if not len(hits):
            return best
        longest = self.groups[-1][0]
        # Stretches of hits that no window spans, none longer than STRETCH words.
        start = 0
        while start < len(hits):
            end = start + 1
            while end < len(hits) and hits[end] - hits[end - 1] <= longest and hits[end] - hits[start] <= STRETCH:
                end += 1
            self.search(h, hits[start:end], longest, best)
            start = end
        return best

    def search(self, h, hits, longest, best) -> None:
        low, high = max(0, int(hits[0]) - longest), min(len(h), int(hits[-1]) + longest + SIZE)
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(signs(h[low:high]), axis=0, dtype=np.int32, out=sums[1:])
        for size, items, prints, tables in self.groups:
            long = min(size, len(h))
            back = np.arange(max(1, long - min(SIZE, long) + 1))
            starts = np.unique((hits[:, None] - back[None, :]).ravel())
            starts = starts[(starts >= low) & (starts + long <= high)]
            if not len(starts):
                continue
            w = fingerprints(sums[starts - low + long] - sums[starts - low])
            listed = np.zeros((len(w), len(prints)), bool)
            for b in range(BLOCKS):
                listed |= tables[b][((w >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
            rows, cols = np.nonzero(listed)
            near = np.bitwise_count(w[rows] ^ prints[cols]) <= RADIUS
            for r, c in zip(rows[near].tolist(), cols[near].tolist()):
                at, item = int(starts[r]), int(items[c])
                got = self.similarity(item, h[at : at + long])
                if got >= SIMILARITY - 1e-12 and (item not in best or got > best[item][0] + 1e-12):
                    best[item] = (got, at, long)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): every benchmark item found in a document."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t"))
    blocks = max(1, -(-items.count() // ITEMS))
    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    out = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        rows = [(r["i"], bytes(r["t"])) for r in sorted(block, key=lambda r: (r["i"] is None, r["i"] or 0)) if r["t"]]
        found = found_in(slim, rows)
        out = found if out is None else out.unionByName(found)
    order = F.struct("similarity", (-F.col("first_word")).alias("a"), "n_words")
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(order).alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.a")).alias("first_word"), "best.n_words")
    )


def found_in(slim: DataFrame, rows: list[tuple[int, bytes]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(rows)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                h = word_hashes(plain_words(value.as_py()))
                for item, (s, at, n) in bench.leaks(h).items():
                    out.append((ids[i].as_py(), bench.items[item][0], s, at, n))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    return slim.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without documents that hold a benchmark item; rows with a null id are kept."""
    bad = leaks(docs, benchmark, id_col, text).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_leaky"), "left_anti")
