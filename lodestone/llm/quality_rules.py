"""Quality rules: a decision list learned by sequential covering, applied as one ordered CASE expression.

Rules are grown on one half of the labelled rows by adding the threshold with the best information
gain, pruned on the other half by dropping trailing conditions, and accepted while they stay precise.
Each step is one grouped count over the labelled statistics; the driver sees thresholds and counts only.
Statistics and verdicts use built-in expressions alone.

Defined results: a null text counts as empty; null ids pass through; repeated rows are judged row by
row; columns of the input that carry an output's name are replaced. With no usable label the list is
empty and only the base rule decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, count_of, let, stored, text_or_empty, words

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window occurring at least twice, its first occurrence included.

    Windows are compared by 64-bit hashes. Most texts repeat none and stop at the distinct count; the
    others sort (hash, position) and add up the union of the repeated windows.
    """

    def hashes(w):
        return F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def same(s, k, other):
        return F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))

    def covered(s):
        hits = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(s, k, k - 1) | same(s, k, k + 1)
        )
        starts = F.sort_array(F.transform(hits, lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            start,
            lambda a, x: F.struct(
                (a["total"] + x + WINDOW - F.greatest(x, a["end"])).alias("total"), (x + WINDOW).alias("end")
            ),
            lambda a: a["total"],
        )

    def total(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(let(tokens, hashes), total).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that base rule and learned rules look at."""
    t = text_or_empty(text)
    lines = let(F.split(t, "\n"), lambda x: F.size(x)).cast("long")
    return docs.withColumns(
        {
            "n_words": let(words(t), F.size).cast("long"),
            "word_chars": (F.length(t) - count_of(t, BLANKS)).cast("long"),
            "n_symbols": count_of(t, SYMBOLS),
            "n_dup_lines": duplicate_lines(t),
            "n_repeat_words": repeated_words(words(t)),
            "n_lines": lines,
            "n_digits": count_of(t, DIGITS),
            "n_marks": count_of(t, "!?"),
            "n_stops": count_of(t, ".,"),
            "n_upper": F.length(t).cast("long")
            - F.length(F.regexp_replace(t, r"[A-Z]+", "")).cast("long"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """Quantities that rules may test, over the columns of :func:`statistics`."""
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_char": per("n_symbols", "word_chars"),
        "digits_per_char": per("n_digits", "word_chars"),
        "upper_per_char": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "stops_per_word": per("n_stops", "n_words"),
        "dup_lines_share": per("n_dup_lines", "n_lines"),
        "repeat_words_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self, over: dict[str, Column]) -> Column:
        c = over[self.feature]
        return c > self.limit if self.above else c <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the document, otherwise it stays."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        over, case = features(), None
        for rule in self.rules:
            test = rule[0].column(over)
            for c in rule[1:]:
                test = test & c.column(over)
            case = F.when(test, True) if case is None else case.when(test, True)
        return F.lit(False) if case is None else case.otherwise(False)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Feature values of at most ``max_labelled`` labelled rows, chosen by the hash of their id.

    The bound belongs to the classifier's training only. An id with several labels takes the lowest.
    """
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") == 0).alias("bad"))
        .withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    seen = statistics(rows).filter(~base_failed())
    return seen.select("bad", "half", *[c.alias(k) for k, c in features().items()])


def thresholds(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Candidate limits: midway between neighbouring quantiles of each feature."""
    probs = [i / cuts for i in range(cuts + 1)]
    got = rows.agg(*[F.percentile_approx(F.col(k), probs, 10_000).alias(k) for k in features()]).first()
    seen = {k: sorted({x for x in got[k] or [] if x is not None}) for k in features()}
    return {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in seen.items()}


def counts_by_limit(rows: DataFrame, limits: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) rows of every feature between neighbouring limits, in one grouped count."""

    def bin_of(k: str, v: list[float]) -> Column:
        passed = F.filter(F.array(*map(F.lit, v)), lambda x: x < F.col(k))
        return F.struct(F.lit(k).alias("f"), F.size(passed).alias("b"))

    bins = [bin_of(k, v) for k, v in limits.items() if v]
    if not bins:
        return {}
    got = (
        rows.select("bad", F.explode(F.array(*bins)).alias("x"))
        .groupBy("x.f", "x.b")
        .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n"))
        .collect()
    )
    out = {k: [(0, 0)] * (len(v) + 1) for k, v in limits.items() if v}
    for r in got:
        out[r["f"]][r["b"]] = (r["p"], r["n"])
    return out


def best_condition(counts, limits, have: tuple[int, int], least: int) -> tuple[float, Condition, tuple] | None:
    """The condition with the greatest gain of information about bad rows."""
    p0, n0 = have
    before, best = math.log2((p0 + 1) / (p0 + n0 + 2)), None
    for k in sorted(counts):
        below_p = below_n = 0
        for i, limit in enumerate(limits[k]):
            below_p += counts[k][i][0]
            below_n += counts[k][i][1]
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if p < least or (p, n) == have:
                    continue
                gain = p * (math.log2((p + 1) / (p + n + 2)) - before)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Condition(k, above, limit), (p, n))
    return best


def matching(rows: DataFrame, rule: list[Condition]) -> DataFrame:
    over = {k: F.col(k) for k in features()}
    for c in rule:
        rows = rows.filter(c.column(over))
    return rows


def totals(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(
        F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("bad")).cast("long")), F.lit(0))
    ).first()
    return r[0], r[1]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 10_000,
    max_rules: int = 8,
    max_conditions: int = 3,
    cuts: int = 64,
    precision: float = 0.97,
    least: int = 5,
) -> DecisionList:
    """Sequential covering: grow on one half, prune on the other, keep rules that stay precise on both."""
    rows = stored(labelled(docs, labels, max_labelled), "quality-labelled")
    limits = thresholds(rows, cuts)
    grow, prune, rules = rows.filter("half = 0"), rows.filter("half = 1"), []
    while len(rules) < max_rules:
        rule, trail, inside = [], [], grow
        have = totals(inside)
        if have[0] < least:
            break
        while len(rule) < max_conditions and have[1]:
            found = best_condition(counts_by_limit(inside, limits), limits, have, least)
            if found is None or found[0] <= 0:
                break
            rule.append(found[1])
            inside, have = matching(inside, [found[1]]), found[2]
            trail.append(have)
        best = None
        for size in range(1, len(rule) + 1):
            p, n = totals(matching(prune, rule[:size]))
            worth = (p - n) / max(p + n, 1)
            if p and (best is None or worth > best[0] + 1e-9):
                best = (worth, size, p, n)
        if best is None:
            break
        size, p, n = best[1], best[2] + trail[best[1] - 1][0], best[3] + trail[best[1] - 1][1]
        if p < precision * (p + n):
            break
        rule = rule[:size]
        rules.append(rule)
        over = {k: F.col(k) for k in features()}
        hit = rule[0].column(over)
        for c in rule[1:]:
            hit = hit & c.column(over)
        grow, prune = grow.filter(~hit), prune.filter(~hit)
    return DecisionList(rules)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    return (
        statistics(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~rules.rejects())
    )
