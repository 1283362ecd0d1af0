"""LM scoring with a probabilistic suffix tree over words.

A text is its words and one end. States of the tree are contexts of up to ``DEPTH`` preceding words (a start
symbol stands before the text). A context is a candidate if it stands ``LEAST_CONTEXT`` times in the training
documents, whatever their number, and becomes a state if its next-word distribution diverges from that of
its suffix: the likelihood gain must exceed half the logarithm of its count for every word it would describe
(words that follow it twice or more). Distributions are smoothed by absolute discounting into the suffix, down to the
share of each word among all training tokens; what the discounts free there is the probability of the one class of
unknown words. A word is scored by the longest state of its context.

Counts, states and described strings are Spark tables keyed by 64-bit hashes; none passes through the driver. The
logarithm of a probability is a sum of one value for each string that ends at the word: what the string gains as a
description, and what its rest costs the next word. So scoring joins the strings of all positions with one table of
values. Two things of bounded size go to tasks, and neither decides a result: a bitmap of the hashes that have a value
(others need no look-up), and the values of the ``HOT_STRINGS`` most frequent strings at most.

Defined results: null text counts as empty and is one end; documents with a null id are trained on;
repeated rows count and are scored row by row; no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, stored
from lodestone.llm.shingles import signed, split_words, word_hashes

DEPTH = 2
LEAST_CONTEXT, LEAST_STRING = 5, 2
#: Values of at most so many frequent strings go to tasks.
HOT_STRINGS = 600_000
DISCOUNT = 0.6
FOLDS, HELD_OUT = 5, 1
#: Strings that a task holds before it hands their counts on; Spark adds them up further before they move.
HELD_GRAMS = 800_000
#: Texts that a task looks up at a time.
HELD_TEXTS = 200
#: Bits of a bitmap of hashes.
BITMAP = 27
#: Hashes of the start and the end.
START_HASH, END_HASH = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
TURN = 23
#: Symbols of the tree in memory: any other word, the start, the end, then words. Three of them fit into 63 bits.
OTHER, START, END, FIRST = 0, 1, 2, 3
BITS = 21


def held_out(id_col: str):
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


# -- strings as hashes ----------------------------------------------------------------------------


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a string from those of its context and last word; ``extended_column`` is the same in Spark."""
    return ((context << np.uint64(TURN)) | (context >> np.uint64(64 - TURN))) ^ word


def extended_column(context: Column, word: Column) -> Column:
    return F.shiftleft(context, TURN).bitwiseOR(F.shiftrightunsigned(context, 64 - TURN)).bitwiseXOR(word)


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in its text, text) of the start, all words and the end of some texts, laid end to end."""
    parts, sizes = [], []
    for value in texts:
        h = word_hashes(split_words(value.as_py()))
        parts += [[START_HASH], h, [END_HASH]]
        sizes.append(len(h) + 2)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum([0, *sizes[:-1]])
    return np.concatenate(parts).astype(np.uint64), np.arange(len(owner)) - first[owner], owner


def longer(strings: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Strings one word longer that end at each place; the first place has none, and holds 0."""
    return np.concatenate([np.zeros(1, np.uint64), extended(strings[:-1], words[1:])])


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << BITMAP) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits of the hashes in column k; a set bit may stem from another hash."""
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    at = F.col("k").bitwiseAND(F.lit((1 << BITMAP) - 1))
    found = keys.select(F.shiftright(at, 15).cast("int").alias("g"), at.bitwiseAND(F.lit(32767)).alias("b"))
    got = found.groupBy("g").agg(F.expr("bitmap_construct_agg(b)").alias("m")).toArrow()
    for g, m in zip(got.column("g").to_pylist(), got.column("m").to_pylist()):
        out[g << 12 : (g + 1) << 12] = np.frombuffer(m, np.uint8)
    return out


def string_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of the distinct strings in ``held``, equal contexts side by side; empties ``held``."""
    c, w = (np.concatenate(x) for x in zip(*held))
    held.clear()
    _, at, n = np.unique(extended(c, w), return_index=True, return_counts=True)
    # Equal contexts side by side are written in less space.
    order = np.argsort(c[at])
    at = at[order]
    return c[at], w[at], n[order]


def count_strings(docs: DataFrame, id_col: str, text: str, level: int, contexts: np.ndarray | None, suffixes: np.ndarray | None) -> DataFrame:
    """(c, w, n) of strings of ``level`` words and one more in training documents; level 1 also counts words, with c null.

    Only strings whose context and suffix are marked are counted; every string that can be described is among them."""

    # A worker would hold what a function brings along twice, as bytes and as arrays.
    marks = None if contexts is None else docs.sparkSession.sparkContext.broadcast((contexts, suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        single: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            h, place, _ = laid_out(batch.column(0))
            below = h
            for _ in range(level - 1):
                below = longer(below, h)
            # The context of a place is the shorter string that ends before it.
            context = np.concatenate([np.zeros(1, np.uint64), below[:-1]])
            use = place >= level
            if marks is not None:
                use &= marked(marks.value[0], context) & marked(marks.value[1], below)
            held.append((context[use], h[use]))
            size += len(held[-1][0])
            if level == 1:
                single.append(h)
            if size > HELD_GRAMS:
                yield from rows(held, single)
                held, single, size = [], [], 0
        yield from rows(held, single)

    def rows(held: list, single: list) -> Iterator[pa.RecordBatch]:
        if held:
            yield from batches_of(*string_counts(held))
        if single:
            w, n = np.unique(np.concatenate(single), return_counts=True)
            yield from batches_of(None, w, n)

    def batches_of(c, w, n) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(w), 100_000):
            part = slice(i, i + 100_000)
            one = pa.nulls(len(w[part]), pa.int64()) if c is None else pa.array(signed(c[part]))
            yield pa.RecordBatch.from_arrays([one, pa.array(signed(w[part])), pa.array(n[part])], ["c", "w", "n"])

    slim = docs.filter(~held_out(id_col)).select(F.col(text).cast("binary").alias("t"))
    return slim.mapInArrow(run, "c bigint, w bigint, n bigint").groupBy("c", "w").agg(F.sum("n").alias("n"))


# -- the tree as tables ---------------------------------------------------------------------------


def level_tables(strings: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strings (k, suffix, n, p, gain) of a level, and its states (k, n, rest), gain and rest in log10.

    ``strings`` are its counts (c, w, n); ``below`` is the level under it, which holds every candidate context and suffix."""
    candidates = below.filter(F.col("n") >= LEAST_CONTEXT).select(F.col("k").alias("c"), F.col("n").alias("total"), F.col("suffix").alias("cs"))
    # The start is not an outcome, so it has no probability.
    tails = below.filter("p is not null").select(F.col("k").alias("suffix"), F.col("p").alias("tail"))
    known = strings.join(candidates, "c").select(
        extended_column(F.col("c"), F.col("w")).alias("k"),
        "c",
        F.when(F.col("cs").isNull(), F.col("w")).otherwise(extended_column(F.col("cs"), F.col("w"))).alias("suffix"),
        "n",
        "total",
    )
    full = stored(known.join(tails, "suffix").withColumn("own", (F.col("n") - DISCOUNT) / F.col("total")), "strings")
    better = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("tail"))
    sums = full.groupBy("c").agg(
        F.sum(better).alias("better"), F.count("*").alias("described"), F.first("total").alias("total"), F.sum("own").alias("own")
    )
    diverges = F.col("better") >= 0.5 * F.log("total") * F.col("described")
    states = stored(sums.filter(diverges).select(F.col("c").alias("k"), F.col("total").alias("n"), F.greatest(1 - F.col("own"), F.lit(1e-9)).alias("rest")), "states")
    solved = full.join(states.select(F.col("k").alias("c"), "rest"), "c", "left").select(
        "k",
        "suffix",
        "n",
        F.coalesce(F.col("own") + F.col("rest") * F.col("tail"), "tail").alias("p"),
        F.log10((F.col("own") + F.col("rest") * F.col("tail")) / F.col("rest") / F.col("tail")).alias("gain"),
    )
    out = stored(solved, "solved")
    discard(full)
    return out, states.select("k", "n", F.log10("rest").alias("rest"))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    counted = stored(count_strings(docs, id_col, text, 1, None, None).filter((F.col("n") >= LEAST_STRING) | F.col("c").isNull()), "grams")
    start, null = F.lit(int(START_HASH)), F.lit(None).cast("bigint")
    words = counted.filter("c is null")
    sums = words.filter(F.col("w") != start).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = sums
    root = F.when(F.col("w") != start, (F.col("n") - DISCOUNT) / max(total, 1))
    below = words.select(F.col("w").alias("k"), null.alias("suffix"), "n", root.alias("p"))
    # One class of unknown words; without training tokens every word is unknown. What a word has more is its value.
    unknown = float(np.log10(max(DISCOUNT * distinct, 0.5) / max(total, 1)))
    none = F.lit(0.0)
    values = [
        below.select(
            "k",
            "n",
            F.when(F.col("p").isNotNull(), F.log10(F.col("n") + 0.5) - float(np.log10(0.5))).otherwise(none).alias("base"),
            F.coalesce(F.log10("p") - unknown, none).alias("lp"),
        )
    ]
    strings = counted.filter("c is not null")
    done = [counted]
    for level in range(1, DEPTH + 1):
        if level > 1:
            marks = [bitmap_of(below.filter(F.col("n") >= least).select("k")) for least in (LEAST_CONTEXT, LEAST_STRING)]
            strings = stored(count_strings(docs, id_col, text, level, *marks).filter(F.col("n") >= LEAST_STRING), "grams")
        below, states = level_tables(strings, below)
        done += [below, states] if level == 1 else [strings, below, states]
        gains = below.filter("gain is not null").select("k", "n", none.alias("base"), F.col("gain").alias("lp"))
        values += [gains, states.select("k", "n", none.alias("base"), F.col("rest").alias("lp"))]
    table = values[0]
    for more in values[1:]:
        table = table.unionByName(more)
    table = stored(table.groupBy("k").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("lp").alias("lp")), "values")
    # All that follows reads the values alone.
    discard(*done)
    hot = F.col("n") >= hot_count(table)
    listed = table.filter(hot).select("k", "base", "lp").toArrow()
    asked = look_ups(docs, id_col, text, listed, bitmap_of(table))
    # The row of a document itself has a key that nothing answers.
    rare = table.filter(~hot).select(F.col("k").alias("key"), F.col("base").alias("more"), F.col("lp").alias("gain"))
    # Many times as many strings are asked for as have a value, so they are not sorted.
    met = asked.join(rare.hint("shuffle_hash"), "key", "left")
    answer = F.col("own").isNull()
    sums = met.groupBy("row").agg(
        F.max("own.doc").alias(id_col),
        F.sum("own.tokens").alias("n_tokens"),
        F.sum(F.when(answer, (F.col("more") > 0).cast("long")).otherwise(F.col("own.known"))).alias("n_known"),
        F.sum(F.when(answer, F.col("more")).otherwise(F.col("own.base"))).alias("base"),
        F.sum(F.when(answer, F.col("gain")).otherwise(F.col("own.lp"))).alias("lp"),
    )
    low = float(np.log10(0.5) - np.log10(total + 0.5 * (distinct + 1)))
    return sums.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("n_tokens") * low).alias("base_score"),
        (F.col("lp") + F.col("n_tokens") * unknown).alias("score"),
    )


def hot_count(table: DataFrame) -> int:
    """A count, a power of the fourth root of 2, that HOT_STRINGS strings of the table reach at most."""
    step = F.floor(4 * F.log2(F.greatest("n", F.lit(1)))).cast("int").alias("step")
    least, size = 4 * 63, 0
    for at, n in sorted(map(tuple, table.groupBy(step).count().collect()), reverse=True):
        size += n
        if size > HOT_STRINGS:
            break
        least = at
    return int(np.ceil(2 ** (least / 4) * (1 - 1e-12)))


def look_ups(docs: DataFrame, id_col: str, text: str, listed: pa.Table, bitmap: np.ndarray) -> DataFrame:
    """One row per document with what the strings in ``listed`` give (own), and one (row, key) per other string with a mark."""
    hot = listed.column("k").to_numpy().view(np.uint64)
    order = np.argsort(hot)
    sent = docs.sparkSession.sparkContext.broadcast(
        (hot[order], listed.column("base").to_numpy()[order], listed.column("lp").to_numpy()[order], bitmap)
    )
    own = pa.struct([("doc", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), HELD_TEXTS):
                yield from answers(batch.slice(i, HELD_TEXTS))

    def answers(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hot, base, lp, bitmap = sent.value
        n = len(batch)
        ids = batch.column(0).to_numpy()
        h, place, owner = laid_out(batch.column(3))
        known, bases, logs = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        keys = h
        for level in range(DEPTH + 1):
            if level:
                keys = longer(keys, h)
            use = place >= level
            k, of = keys[use], owner[use]
            use = marked(bitmap, k)
            k, of = k[use], of[use]
            at = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
            hit = hot[at] == k if len(hot) else np.zeros(len(k), bool)
            at, by = at[hit], of[hit]
            known += np.bincount(by, base[at] > 0, n).astype(np.int64)
            bases += np.bincount(by, base[at], n)
            logs += np.bincount(by, lp[at], n)
            k, of = k[~hit], of[~hit]
            for i in range(0, len(k), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(signed(k[part])), pa.array(ids[of[part]]), pa.nulls(len(k[part]), own)], ["key", "row", "own"])
        # The start is no token.
        tokens = np.bincount(owner, minlength=n) - 1
        found = pa.StructArray.from_arrays([batch.column(2), *(pa.array(x) for x in (tokens, known, bases, logs))], fields=list(own))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), found], ["key", "row", "own"])

    row = F.monotonically_increasing_id()
    slim = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text).cast("binary").alias("t"))
    slim = slim.select("row", F.xxhash64("row").alias("key"), "doc", "t")
    return slim.mapInArrow(run, "key bigint, row bigint, own struct<doc:bigint,tokens:bigint,known:bigint,base:double,lp:double>")


# -- the tree in memory ---------------------------------------------------------------------------
# The same model over counts that fit into arrays; tests compare the tables with it.


@dataclass
class Words:
    """Frequent words by symbol, with the counts of all symbols."""

    index: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int

    def symbols(self, text: bytes | None) -> tuple[list[bytes], np.ndarray]:
        """Words of a text, and their symbols with the end."""
        words = (text or b"").lower().split()
        out = np.empty(len(words) + 1, np.int64)
        get = self.index.get
        out[:-1] = np.fromiter((get(w, OTHER) for w in words), np.int64, len(words))
        out[-1] = END
        return words, out


def contexts(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, one before, two before) of all positions of some texts, laid end to end."""
    w, one, two = [], [], []
    for s in symbols:
        before = np.concatenate([[START, START], s])
        w.append(s)
        one.append(before[1:-1])
        two.append(before[:-2])
    return np.concatenate(w), np.concatenate(one), np.concatenate(two)


@dataclass
class Level:
    """States of one context length and the strings they describe, sorted, in log10."""

    states: np.ndarray
    rests: np.ndarray
    strings: np.ndarray
    logs: np.ndarray

    def find(self, context: np.ndarray, string: np.ndarray):
        """(is a state, log of its rest, is described, log of its probability) of every position."""
        state, rest = lookup(self.states, self.rests, context)
        hit, log = lookup(self.strings, self.logs, string)
        return state, rest, hit & state, log


def lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


class Tree:
    def __init__(self, words: Words, v: np.ndarray, n: np.ndarray, total: np.ndarray):
        self.root = np.maximum(words.counts - DISCOUNT, 0) / max(words.total, 1)
        self.levels: list[Level] = []
        mask = (1 << BITS) - 1
        long = v >> (2 * BITS) > 0
        below = lambda s: self.root[s & mask]
        for part in (~long, long):
            s, count, of = v[part], n[part], total[part]
            order = np.argsort(s)
            s, count, of = s[order], count[order], of[order]
            tails = below(s)
            context, first, inverse = np.unique(s >> BITS, return_index=True, return_inverse=True)
            gain = np.bincount(inverse, count * np.log((count / np.maximum(of, 1)) / np.maximum(tails, 1e-300)), len(context))
            described = np.bincount(inverse, minlength=len(context))
            diverges = gain >= 0.5 * np.log(np.maximum(of[first] if len(s) else of, 2)) * described
            own = (count - DISCOUNT) / np.maximum(of, 1)
            rest = np.maximum(1 - np.bincount(inverse, own, len(context)), 1e-9)
            p = own + rest[inverse] * tails if len(s) else own
            keep = diverges[inverse] if len(s) else np.zeros(0, bool)
            level = Level(context[diverges], np.log10(rest[diverges]), s[keep], np.log10(p[keep]))
            self.levels.append(level)
            below = lambda x, level=level, lower=below: self.suffix(level, lower, x)

    @staticmethod
    def suffix(level: Level, lower, string: np.ndarray) -> np.ndarray:
        """Probability of the last symbol after the context without its first word."""
        short = string & ((1 << 2 * BITS) - 1)
        state, rest, hit, log = level.find(short >> BITS, short)
        return np.where(hit, 10**log, np.where(state, 10**rest, 1.0) * lower(string))

    def score(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of every position; of OTHER words only the part that precedes their own share."""
        out, live = np.zeros(len(w)), np.ones(len(w), bool)
        short = one << BITS | w
        strings = (((two + 1) << BITS | one) << BITS | w, short)
        for level, string in zip(reversed(self.levels), strings):
            state, rest, hit, log = level.find(string >> BITS, string)
            out += np.where(live & hit, log, np.where(live & state, rest, 0.0))
            live &= ~hit
        with np.errstate(divide="ignore"):
            plain = np.log10(self.root)
        use = live & (w != OTHER)
        out[use] += plain[w[use]]
        return out
