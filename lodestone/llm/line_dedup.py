"""Line dedup: a later line goes when an earlier one equals it or lies within a small edit distance.

Segment-partition join: a line is cut into threshold + 1 segments, so whatever lies within the threshold
holds one of them unchanged near its place. Lines are indexed by (length, segment number, segment); each
line looks its substrings up for its own length and the lengths up to the threshold below, only at the
shifts that some alignment within the threshold allows. Only lines behind a key that several lines share go
on, with a sketch: whether the number of their letter pairs in each of 128 buckets is odd. An edit changes four letter
pairs at most, so sketches of lines within the threshold differ in few bits; where a key is shared by many lines,
they also have to agree in one of as many parts of the sketch, plus one, as bits can differ. What passes is verified
by a banded bit-parallel edit distance. Built-in expressions only.

A line needs one earlier line to go. So every line first meets the earliest of its group, and only lines that are left
after that meet all earlier ones.

A line is named by its hash; its first occurrence is the one of lowest (id, line number). A line that
copies or nearly copies a line with an earlier first occurrence is removed everywhere, other lines stay
at their first occurrence. Lines are compared without surrounding white space.

Defined results: lines of fewer than ``min_chars`` characters are neither compared nor removed, so short
and empty texts stay as they are; a null text stays null; rows with a null id pass unchanged; rows of
equal id and text count as one document; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, let, stored

MIN_CHARS = 20
THRESHOLD = 2
#: Lines of more than 1/HOT_SHARE of all rows; there are fewer than that, so their list is broadcast.
HOT_SHARE = 1000
#: Lines whose keys share a partition, twelve keys each, so that sorting them needs no disk.
LINES_PER_PART = 30_000
#: Lines behind one key that meet without having a part of their sketches in common.
SMALL_GROUP = 64
#: Bits of a sketch, in two words.
SKETCH = 128
#: Lines are sent to all tasks, to filter documents before they move, up to this many.
SENT_LINES = 500_000


def occurrences(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(d, at, line) of every line long enough to be compared."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("d"), F.posexplode(lines).alias("at", "line"))
        .filter(F.length("line") >= min_chars)
    )


def name(line: str) -> Column:
    return F.xxhash64(line)


def sketch(line: str) -> Column:
    """(lo, hi): for each of 128 buckets whether the pairs of neighbouring characters in it are odd in number."""

    def flipped(word, x, half):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.when(F.shiftright(x, 6).bitwiseAND(F.lit(1)) == half, word.bitwiseXOR(bit)).otherwise(word)

    def folded(chars):
        pairs = F.transform(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda c, i: F.xxhash64(F.get(chars, i), c))
        zero = F.lit(0).cast("long")
        return F.aggregate(
            pairs,
            F.struct(zero.alias("lo"), zero.alias("hi")),
            lambda s, x: F.struct(flipped(s["lo"], x, 0).alias("lo"), flipped(s["hi"], x, 1).alias("hi")),
        )

    return let(F.regexp_extract_all(F.col(line), F.lit("(?s)."), F.lit(0)), folded)


def could_be_near(a: Column, b: Column, t: int) -> Column:
    """Whether lengths and sketches allow an edit distance of t; a substitution changes four pairs, other edits three."""
    apart = F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))
    return (F.abs(a["size"] - b["size"]) <= t) & (apart <= 4 * t)


def parts_of(lo: Column, hi: Column, t: int) -> Column:
    """Hashes of 4 t + 1 parts of a sketch; of lines within t, at least one is equal."""
    n, out = 4 * t + 1, []
    for j in range(n):
        low, high = (sum(1 << b for b in range(64) if (b + base) % n == j) for base in (0, 64))
        signed = [m - (1 << 64) if m >> 63 else m for m in (low, high)]
        out.append(F.xxhash64(F.lit(j), lo.bitwiseAND(F.lit(signed[0]).cast("long")), hi.bitwiseAND(F.lit(signed[1]).cast("long"))))
    return F.array(*out)


def segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of t + 1 in a line of this length."""
    start = F.floor(length * i / (t + 1)).cast("int")
    return start, F.floor(length * (i + 1) / (t + 1)).cast("int") - start


def shifts(i: int, delta: int, t: int) -> range:
    """Where segment i of a line shorter by ``delta`` can stand, relative to its own start."""
    return range(max(-i, delta - (t - i)), min(i, delta + (t - i)) + 1)


def keys(line: str, t: int) -> Column:
    """(k, own) of every look-up: hash of (length, segment number, substring); own: the line is indexed there."""
    size, out = F.length(line), []
    for delta in range(t + 1):
        for i in range(t + 1):
            start, long = segment(size - delta, i, t)
            for s in shifts(i, delta, t):
                k = F.xxhash64(size - delta, F.lit(i), F.substring(F.col(line), start + s + 1, long))
                out.append(F.struct(k.alias("k"), F.lit(int(delta == 0 and s == 0)).alias("own")))
    return F.array(*out)


def edit_distance(a: Column, b: Column, t: int) -> Column:
    """Edit distance of two strings up to t, t + 1 beyond; b must be no longer than a and by t at most.

    Bit k of the words stands for row j - t + k of column j: positive and negative vertical differences
    move along the diagonal as one machine word per column. The score follows the band's lowest row and,
    from the last row on, runs along it.
    """
    width = 2 * t + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def chars(x):
        return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    def walk(p):
        rows, cols = p["a"], p["b"]
        down = F.size(rows) - t
        start = F.struct(
            F.lit(mask & ~((1 << t) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(t).alias("n")
        )

        def step(s, j):
            # The score never falls on the diagonal, and by t at most along the last row.
            return F.when(s["n"] > 2 * t, s).otherwise(moved(s, j))

        def moved(s, j):
            equal = F.lit(0).cast("long")
            for k in range(width):
                hit = F.coalesce(F.get(rows, j - t + k) == F.get(cols, j), F.lit(False))
                equal = equal.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            return let(F.struct(equal.alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn")), lambda w: diagonal(w, s["n"], j))

        def diagonal(w, n, j):
            x, vp, vn = w["x"], w["vp"], w["vn"]
            d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))
            return let(F.struct(d0.alias("d"), vp.alias("vp"), vn.alias("vn")), lambda v: after(v, n, j))

        def after(v, n, j):
            d, vp, vn = v["d"], v["vp"], v["vn"]
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(F.lit(mask)))
            hn = d.bitwiseAND(vp)
            half = F.shiftright(d, 1)
            along = F.call_function("shiftright", F.lit(top >> 1).cast("long"), j - down)
            score = F.when(
                j < down, n + F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            ).otherwise(
                n
                + F.when(hp.bitwiseAND(along) != 0, 1).otherwise(0)
                - F.when(hn.bitwiseAND(along) != 0, 1).otherwise(0)
            )
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(mask))).alias("vp"),
                half.bitwiseAND(hp).alias("vn"),
                score.cast("int").alias("n"),
            )

        walked = F.aggregate(F.sequence(F.lit(0), F.size(cols) - 1), start, step, lambda s: s["n"])
        return F.least(walked, F.lit(t + 1))

    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), walk)


def first_lines(lines: DataFrame) -> DataFrame:
    """(h, first, copies): every distinct line with its first occurrence."""
    return lines.groupBy(name("line").alias("h")).agg(
        F.min(F.struct("d", "at")).alias("first"), F.count(F.lit(1)).alias("copies")
    )


def shared_keys(lines: DataFrame, firsts: DataFrame, t: int) -> DataFrame:
    """(k, h, own, n) of lines behind keys that several lines have and one is indexed under; n: how many."""
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    hot = firsts.filter(F.col("copies") > total / HOT_SHARE).select("h", "first")
    # Of a hot line only the first occurrence is looked up, so no key gathers its copies.
    seen = (
        lines.withColumn("h", name("line"))
        .join(F.broadcast(hot), "h", "left")
        .filter("first is null or (d = first.d and at = first.at)")
        .select("h", "line")
    )
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LINES_PER_PART)
    rows = seen.select("h", F.explode(keys("line", t)).alias("x")).select("h", "x.k", "x.own").repartition(parts, "k")
    group = Window.partitionBy("k")
    return (
        rows.withColumns({"lo": F.min("h").over(group), "hi": F.max("h").over(group), "any": F.max("own").over(group)})
        .filter("lo <> hi and any = 1")
        .groupBy("k", "h")
        .agg(F.max("own").alias("own"))
        .withColumn("n", F.count(F.lit(1)).over(group))
    )


def texts_of(docs: DataFrame, id_col: str, text: str, named: DataFrame) -> DataFrame:
    """(h, first, line, size, lo, hi) of the lines in ``named`` (h, first)."""
    wanted = named.groupBy(F.col("first.d").alias("d")).agg(F.collect_set("first.at").alias("ats"))
    if named.count() <= SENT_LINES:
        wanted = F.broadcast(wanted)
    found = (
        docs.select(F.col(id_col).alias("d"), F.col(text).alias("t"))
        .join(wanted, "d")
        .select(let(F.split("t", "\n"), lambda x: F.transform("ats", lambda i: F.btrim(F.get(x, i), F.lit(BLANKS)))).alias("x"))
        .select(F.explode("x").alias("line"))
        .filter("line is not null")
        .select(name("line").alias("h"), "line")
        .join(named, "h")
        .groupBy("h", "first")
        .agg(F.min("line").alias("line"))
    )
    return found.select("h", "first", "line", F.length("line").alias("size"), sketch("line").alias("s")).select("h", "first", "line", "size", "s.lo", "s.hi")


def near_lines(pairs: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """(h) of the lines a in ``pairs`` (a, b) that lie within t of b."""
    left = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x"), F.col("size").alias("m")), "a")
    both = left.join(texts.select(F.col("h").alias("b"), F.col("line").alias("y"), F.col("size").alias("n")), "b")
    longer = F.col("m") >= F.col("n")
    return (
        both.select("a", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(longer, F.col("y")).otherwise(F.col("x")).alias("q"))
        .filter(edit_distance(F.col("p"), F.col("q"), t) <= t)
        .select(F.col("a").alias("h"))
        .distinct()
    )


def met_first(members: DataFrame, t: int) -> DataFrame:
    """(a, b): every line with the earliest line of its group, and the earliest that is indexed there."""
    group = Window.partitionBy("k", "part")
    return (
        members.withColumn("lead", F.min(F.when(F.col("own") == 1, F.col("me"))).over(group))
        .withColumn("head", F.when(F.col("own") == 1, F.min("me").over(group)))
        .select("me", F.explode(F.array_compact(F.array("lead", "head"))).alias("o"))
        .filter((F.col("o.first") < F.col("me.first")) & could_be_near(F.col("me"), F.col("o"), t))
        .select(F.col("me.h").alias("a"), F.col("o.h").alias("b"))
        .distinct()
    )


def met_all(members: DataFrame, gone: DataFrame, t: int) -> DataFrame:
    """(a, b): every line that is not among ``gone`` with all earlier lines of its group."""
    me = members.join(gone, F.col("me.h") == gone.h, "left_anti").select("k", "part", "me", "own")
    other = members.select(F.col("k").alias("kb"), F.col("part").alias("pb"), F.col("me").alias("o"), F.col("own").alias("oo"))
    same = (F.col("k") == F.col("kb")) & (F.col("part") == F.col("pb"))
    earlier = (F.col("o.first") < F.col("me.first")) & ((F.col("own") == 1) | (F.col("oo") == 1))
    joined = me.join(other, same & earlier & could_be_near(F.col("me"), F.col("o"), t))
    return joined.select(F.col("me.h").alias("a"), F.col("o.h").alias("b")).distinct()


def redundant(docs: DataFrame, id_col: str, text: str, min_chars: int, t: int) -> DataFrame:
    """(d, drop): for every document that loses lines, their numbers."""
    lines = occurrences(docs, id_col, text, min_chars)
    firsts = stored(first_lines(lines), "first-lines")
    shared = stored(shared_keys(lines, firsts, t), "shared-keys")
    named = stored(shared.select("h").distinct().join(firsts.select("h", "first"), "h"), "shared-lines")
    texts = stored(texts_of(docs, id_col, text, named), "line-texts")
    part = F.when(F.col("n") > SMALL_GROUP, parts_of(F.col("lo"), F.col("hi"), t)).otherwise(F.array(F.lit(0).cast("long")))
    members = stored(
        shared.join(texts.drop("line"), "h").select(
            "k", F.explode(part).alias("part"), "own", F.struct("first", "h", "size", "lo", "hi").alias("me")
        ),
        "line-groups",
    )
    near = stored(near_lines(met_first(members, t), texts, t), "near-lines")
    rest = stored(near_lines(met_all(members, near, t), texts, t), "near-lines")
    gone = near.unionByName(rest).withColumn("near", F.lit(True))
    known = firsts.join(gone, "h", "left").filter("copies > 1 or near")
    return (
        lines.select("d", "at", name("line").alias("h"))
        .join(known, "h")
        .filter("near or d <> first.d or at <> first.at")
        .groupBy("d")
        .agg(F.collect_set("at").alias("drop"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with redundant lines taken out of the text; all rows and columns stay."""
    gone = redundant(docs, id_col, text, min_chars, threshold).withColumnsRenamed({"d": "_gone_id", "drop": "_gone"})
    left = let(
        F.split(F.col(text), "\n"),
        lambda x: F.concat_ws("\n", F.filter(x, lambda _, i: ~F.array_contains(F.col("_gone"), i))),
    )
    return (
        docs.join(gone, F.col(id_col) == F.col("_gone_id"), "left")
        .withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left))
        .drop("_gone_id", "_gone")
    )
