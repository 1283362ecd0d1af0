"""Cross-tokenizer alignment with exact-text deduplication.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned once, with its
number of copies. Byte offsets where tokens of both tokenizers end cut the text into groups; every pair of
tokens in a group is a link. Pair counts add up the distinct pairs of each text times its copies. Measures
that need the counts are computed per distinct text and joined to the documents by the text's SHA-256.

Counts of at most ``SENT_PAIRS`` frequent pairs go to all tasks as a sorted table; links of rarer pairs meet their
counts in a join, which has no hot key because each of its pairs is rare. Results don't depend on the bound.

Neither tokenizer joins across a single blank between two other characters, so such stretches are looked up
in a bounded cache; other white space stays inside a stretch. A text that has a stretch whose tokens don't give back its
bytes is judged as a whole.

Defined results: texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens, zeros
and empty groups. Null ids and repeated rows pass row by row and each counts as a document; other input columns
are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import byte_alphabet
from lodestone.llm.common import RecentCache, stored

#: Counts of this many pairs at most go to all tasks, 17 bytes each.
SENT_PAIRS = 1_000_000
#: Pairs a task gathers before it passes their counts on.
HELD_PAIRS = 2_000_000
CACHE_STRETCHES = 400_000
LONGEST_CACHED = 64
SLICE = 200

_LOADED: dict[tuple[str, str], Aligner] = {}

#: Marks a stretch that is no unit of its own: empty, or with white space at an end.
LOOSE = ()


class Aligner:
    """Tokenizer A (byte-level, given a leading space) and tokenizer B (pieces, adds the space itself)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self.bytes_a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        small = max(self.a.get_vocab_size(), len(self.bytes_b)) <= 1 << 16
        #: Pairs are a << shift | b.
        self.shift, self.code = (16, "I") if small else (32, "Q")
        self.kind = np.dtype(self.code)
        self.size_a = [len(self.bytes_a.get(i, b"")) for i in range(self.a.get_vocab_size())]
        self.size_b = [len(x) for x in self.bytes_b]
        self.shown = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        self.cache = RecentCache(CACHE_STRETCHES)

    def entry(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(groups, tokens of A, of B, groups, links, pairs) of a text, None if its bytes aren't given back."""
        whole = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        show_a, show_b = list(map(self.shown.__getitem__, a)), list(map(self.shown.__getitem__, b))
        if len(a) == 1 or len(b) == 1:
            cuts = [(len(a), len(b))]
        else:
            ends_a = list(accumulate(map(self.size_a.__getitem__, a)))
            ends_b = list(accumulate(map(self.size_b.__getitem__, b)))
            both = sorted(set(ends_a).intersection(ends_b))
            cuts = [(bisect_left(ends_a, e) + 1, bisect_left(ends_b, e) + 1) for e in both]
        i0 = j0 = 0
        groups, pairs = [], []
        for i, j in cuts:
            groups.append(f"{','.join(show_a[i0:i])}|{','.join(show_b[j0:j])}")
            pairs += [x << self.shift | y for x in a[i0:i] for y in b[j0:j]]
            i0, j0 = i, j
        return ";".join(groups), len(a), len(b), len(groups), len(pairs), array(self.code, pairs).tobytes()

    def entries(self, texts: list[str]) -> list[tuple | None]:
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [self.entry(t, e.ids, b) for t, e, b in zip(texts, found, self.b.encode(texts, num_threads=1))]

    def look_up(self, split: list[list[str]]) -> dict[str, tuple | None]:
        """A table that holds the entries of all stretches, for now; short ones are remembered."""
        new = self.cache.missing(set().union(*split))
        known = self.cache.young
        tight = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        known.update(dict.fromkeys(new, LOOSE))
        known.update(zip(tight, self.entries(tight)))
        return known

    def align(self, texts: list[str]) -> list[tuple | None]:
        """The entry of every whole text."""
        split = [t.split(" ") for t in texts]
        known = self.look_up(split)
        out, whole = [], []
        for k, (text, parts) in enumerate(zip(texts, split)):
            got = [known[s] for s in parts]
            if None in got or LOOSE in got:
                whole.append(k)
                out.append(None)
                continue
            shown, n_a, n_b, n_groups, n_links, pairs = zip(*got)
            out.append((";".join(shown), sum(n_a), sum(n_b), sum(n_groups), sum(n_links), b"".join(pairs)))
        for k, found in zip(whole, self.entries([texts[k] for k in whole])):
            out[k] = found
        for s in {s for parts in split for s in parts if len(s) > LONGEST_CACHED}:
            del known[s]
        return out


def load(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _LOADED:
        _LOADED[key] = Aligner(path_a, path_b)
    return _LOADED[key]


def text_key(text: str):
    return F.unhex(F.sha2(F.col(text), 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row per distinct text: text_key, copies, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` shows the ids of A and B of every group; ``pairs`` and ``times`` are little-endian arrays of the distinct
    linked pairs and of how often each is linked.
    """
    usable = docs.filter(F.length(text) > 0).select(F.col(text).alias("text"))
    distinct = usable.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                found = [e or ("", 0, 0, 0, 0, b"") for e in aligner.align(batch.column(2).to_pylist())]
                pairs, times = [], []
                for e in found:
                    u, n = np.unique(np.frombuffer(e[5], aligner.kind), return_counts=True)
                    pairs.append(u.tobytes())
                    times.append(n.astype("<u4").tobytes())
                counts = [pa.array([e[i] for e in found], pa.int64()) for i in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        *counts,
                        pa.array([e[0] for e in found], pa.string()),
                        pa.array(pairs, pa.binary()),
                        pa.array(times, pa.binary()),
                    ],
                    ["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    return distinct.select(text_key("text").alias("text_key"), "copies", "text").mapInArrow(
        run,
        "text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string,"
        " pairs binary, times binary",
    )


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, a, b, n, best): in how many documents a pair is linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = load(path_a, path_b).kind
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in held]))
            return keys, counts

        def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for copies, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(pairs, kind)
                held.append((keys, np.full(len(keys), copies, np.int64)))
                size += len(keys)
                if size > HELD_PAIRS:
                    keys, counts = merged()
                    held, size = [(keys, counts)], len(keys)
                    if size > HELD_PAIRS // 2:
                        yield batch_of(keys, counts)
                        held, size = [], 0
        if held:
            yield batch_of(*merged())

    shift = load(path_a, path_b).shift
    counts = (
        aligned.select("copies", "pairs")
        .mapInArrow(run, "pair bigint, n bigint")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .select(
            "pair",
            F.shiftright("pair", shift).cast("int").alias("a"),
            F.col("pair").bitwiseAND((1 << shift) - 1).cast("int").alias("b"),
            "n",
        )
    )
    counts = stored(counts, "pair-counts")
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("_most"))
    return counts.join(most, F.col("a") == F.col("_a")).select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the highest counts, at most ``most`` of them, and the rest; cut at a power of two."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())  # 63 rows at most
    low, total = 64, 0
    while low > 0 and total + sizes.get(low - 1, 0) <= most:
        low -= 1
        total += sizes.get(low, 0)
    return counts.filter(level >= low), counts.filter(level < low)


def measures(aligned: DataFrame, counts: DataFrame, path_a: str, path_b: str, sent: int = SENT_PAIRS) -> DataFrame:
    """(text_key, n_best, count_sum) of every aligned text."""
    top, rare = frequent(counts, sent)
    table = top.select("pair", "n", "best").toArrow()  # at most ``sent`` rows
    order = np.argsort(keys := table["pair"].to_numpy())
    known = aligned.sparkSession.sparkContext.broadcast(
        (keys[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order].astype(bool))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = load(path_a, path_b).kind
        keys, counts, best = known.value
        for batch in batches:
            out: list[tuple] = []
            for key, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = np.frombuffer(pairs, kind).astype(np.int64)
                times = np.frombuffer(times, "<u4").astype(np.int64)
                at = np.searchsorted(keys, pairs)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == pairs[hit]
                at, seen = at[hit], times[hit]
                out.append((key, None, None, int(seen[best[at]].sum()), int((seen * counts[at]).sum())))
                out += [(key, p, t, 0, 0) for p, t in zip(pairs[~hit].tolist(), times[~hit].tolist())]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["text_key", "pair", "times", "n_best", "count_sum"],
            )

    got = aligned.select("text_key", "pairs", "times").mapInArrow(
        run, "text_key binary, pair bigint, times bigint, n_best bigint, count_sum bigint"
    )
    if rare.isEmpty():
        return got.select("text_key", "n_best", "count_sum")
    got = stored(got, "measures")
    late = (
        got.filter("pair IS NOT NULL")
        .join(rare.select("pair", "n", "best"), "pair")
        .select("text_key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    )
    return (
        got.filter("pair IS NULL")
        .select("text_key", "n_best", "count_sum")
        .unionByName(late)
        .groupBy("text_key")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )


def alignment_measures(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", sent: int = SENT_PAIRS
) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = stored(
        aligned_texts(docs, path_a, path_b, text).select("text_key", "copies", *numbers, digest, "pairs", "times"),
        "aligned",
    )
    counted = measures(aligned, pair_counts(aligned, path_a, path_b), path_a, path_b, sent)
    of_text = aligned.select("text_key", *numbers, "groups_sha256").join(counted, "text_key")
    rows = docs.select(F.col(key).alias("_id"), F.when(F.length(text) > 0, text_key(text)).alias("text_key"))
    zero = F.lit(0).cast("bigint")
    return rows.join(of_text, "text_key", "left").select(
        F.col("_id").alias(key),
        *[F.coalesce(F.col(c), zero).alias(c) for c in (*numbers, "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
