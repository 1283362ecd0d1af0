"""Scores, coarse and fine ranking, training set and learned model, diversity reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard, title_words, tokens
from lodestone.operators.index import TextIndex, match_postings
from lodestone.operators.recall import DAY, HISTORY, HOT, VECTOR, bm25_sum
from lodestone.session import cut_lineage
from lodestone.skew import top_k

# Default stage weights.
COARSE_WEIGHTS = (0.6, 0.2, 0.2)
FINE_WEIGHT = 0.8

LTR_FEATURES = [
    "f_query_len",
    "f_bm25",
    "f_quality",
    "f_freshness",
    "f_log_click",
    "f_log_like",
    "f_title_len",
    "f_term_match",
    "f_category_match",
    "f_source",
]


def score_bm25(
    cands: DataFrame,
    queries: DataFrame,
    index: TextIndex,
    k1: float = 1.5,
    b: float = 0.75,
    idf: str = "index",
) -> DataFrame:
    """Fill ``bm25`` = tanh(Σ/10) of candidates; 0 where no term matches.

    Candidates that carry the score of their recall keep it; the others are scored in one more pass over the asked
    postings, each with the terms of its own query. ``idf="unit"`` weighs all terms alike.
    """
    if "bm25" not in cands.columns:
        cands = cands.withColumn("bm25", F.lit(None).cast("double"))
    unscored = cands.filter("bm25 IS NULL").select("query_id", "doc_id")
    hits = match_postings(queries, index, unscored.distinct())
    scored = hits.groupBy("query_id", "doc_id").agg(bm25_sum(index, k1, b, idf).alias("_bm25"))
    found = unscored.join(scored, ["query_id", "doc_id"])
    return (
        cands.join(found, ["query_id", "doc_id"], "left")
        .withColumn("bm25", F.coalesce("bm25", "_bm25", F.lit(0.0)))
        .drop("_bm25")
    )


def score_quality(
    cands: DataFrame, click_weight: float = 0.3, like_weight: float = 0.4, quality_weight: float = 0.3
) -> DataFrame:
    clamped = F.least(F.greatest(F.col("quality_score"), F.lit(0.0)), F.lit(1.0))
    return cands.withColumn(
        "quality",
        click_weight * F.tanh(F.log1p("click_count") / 5)
        + like_weight * F.tanh(F.log1p("like_count") / 5)
        + quality_weight * clamped,
    )


def score_freshness(cands: DataFrame, as_of: int, rate: float = 0.01, max_age_days: float = 365) -> DataFrame:
    age = (F.lit(as_of) - F.col("publish_time")) / float(DAY)
    fresh = F.when((age >= 0) & (age <= max_age_days), F.exp(-rate * age)).otherwise(0.0)
    return cands.withColumn("freshness", fresh)


def rounded(c: Column | str) -> Column:
    """Scores are compared at six decimals so equal documents tie and ids decide."""
    return F.round(c, 6)


def coarse_rank(
    cands: DataFrame, weights: tuple[float, float, float] = COARSE_WEIGHTS, top_k_: int = 500
) -> DataFrame:
    """Weighted sum of the three scores, best ``top_k_`` per query, with a debug map.

    A column ``coarse_top_k`` of the candidates lowers the limit for its query.
    """
    wb, wq, wf = weights
    own = "coarse_top_k" if "coarse_top_k" in cands.columns else None
    score = rounded(wb * F.col("bm25") + wq * F.col("quality") + wf * F.col("freshness"))
    scored = cands.withColumn("coarse_score", score)
    ranked = top_k(scored, ["query_id"], [F.desc("coarse_score"), F.asc("doc_id")], top_k_, "doc_id", "coarse_rank", own)
    names = ("bm25", "quality", "freshness")
    debug = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return ranked.withColumn("debug_scores", debug)


def log_signal(count: str) -> Column:
    return F.tanh(F.log1p(F.col(count).cast("double")) / 5)


def ltr_features(cands: DataFrame, queries: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The ten ranking features ``f_*`` per candidate."""
    q = queries.select("query_id", "uid", "terms")
    rows = cands.join(q, "query_id")
    if profiles is not None:
        rows = rows.join(profiles.select("uid", "category_weights"), "uid", "left")
    else:
        rows = rows.withColumn("category_weights", F.lit(None).cast("map<string,double>"))
    return rows.withColumns(feature_columns()).drop("uid", "terms", "category_weights")


def feature_columns() -> dict[str, Column]:
    """The ten features of rows with terms, title, category, category_weights, scores, counts and recall_source."""
    hits = F.filter(
        "terms", lambda t: (t != "") & (F.col("title").contains(t) | F.col("category").contains(t))
    )
    liked = F.when(
        F.col("category") != "", F.try_element_at(F.col("category_weights"), F.col("category"))
    )
    source = (
        F.when(F.col("recall_source") == VECTOR, 1 / 3)
        .when(F.col("recall_source") == HOT, 2 / 3)
        .when(F.col("recall_source") == HISTORY, 1.0)
        .otherwise(0.0)
    )
    return {
        "f_query_len": F.tanh(F.size("terms") / 5),
        "f_bm25": F.col("bm25"),
        "f_quality": F.col("quality"),
        "f_freshness": F.col("freshness"),
        "f_log_click": log_signal("click_count"),
        "f_log_like": log_signal("like_count"),
        "f_title_len": F.tanh(F.octet_length("title") / 30),
        "f_term_match": F.tanh(F.size(hits) / 3),
        "f_category_match": F.least(F.lit(1.0), F.coalesce(liked, F.lit(0.0)) * 2),
        "f_source": source,
    }


def rule_score() -> Column:
    """Three fixed rules averaged and squashed to 0–1."""
    # Every threshold and leaf of the three trees below.
    bm25, quality, fresh = F.col("f_bm25"), F.col("f_quality"), F.col("f_freshness")
    click, like = F.col("f_log_click"), F.col("f_log_like")
    match, category = F.col("f_term_match"), F.col("f_category_match")

    def pick(cond: Column, yes: float, no: float) -> Column:
        return F.when(cond, yes).otherwise(no)

    relevance = (
        F.when((bm25 > 0.5) | (match > 0.5), pick(quality > 0.3, 0.8, 0.5))
        .when(bm25 > 0.2, pick(fresh > 0.5, 0.4, 0.2))
        .otherwise(pick(click > 0.3, 0.1, -0.1))
    )
    standing = (
        F.when(quality > 0.6, pick((category > 0.3) | (like > 0.3), 0.7, 0.4))
        .when(quality > 0.3, pick(bm25 > 0.3, 0.3, 0.1))
        .otherwise(pick(fresh > 0.7, 0.2, -0.2))
    )
    interest = (
        F.when((click > 0.5) | (like > 0.5), pick(bm25 > 0.1, 0.6, 0.3))
        .when(fresh > 0.8, 0.3)
        .otherwise(-0.1)
    )
    return (F.tanh((relevance + standing + interest) / 3 * 2) + 1) / 2


def score_rules(features: DataFrame) -> DataFrame:
    return features.withColumn("model_score", rule_score())


def score_model(features: DataFrame, model: RankModel | None = None) -> DataFrame:
    """``model_score`` between 0 and 1 from a trained model, or from the fixed rules when there is none."""
    if model is None:
        return score_rules(features)
    return model.score(features).withColumn("model_score", 1 / (1 + F.exp(-F.col("model_score"))))


def fine_rank(cands: DataFrame, weight: float = FINE_WEIGHT, top_k_: int = 100) -> DataFrame:
    """fine = model score × weight; final = fine, or coarse where fine is 0. Best ``top_k_`` per query.

    A column ``fine_top_k`` of the candidates lowers the limit for its query.
    """
    fine = rounded(F.col("model_score") * weight)
    scored = cands.withColumn("fine_score", fine).withColumn(
        "final_score", F.when(F.col("fine_score") > 0, F.col("fine_score")).otherwise(F.col("coarse_score"))
    )
    return top_k(scored, ["query_id"], [F.desc("final_score"), F.asc("doc_id")], top_k_, "doc_id", "fine_rank", "fine_top_k" if "fine_top_k" in cands.columns else None)


# ---------------------------------------------------------------- training


def training_set(
    event_log: DataFrame, shown: DataFrame | None = None, corpus: DataFrame | None = None, profiles: DataFrame | None = None
) -> DataFrame:
    """Labelled feature snapshots grouped by (uid, query).

    Clicks, likes and shares are 1, dismissals 0. With the shown results (uid, query, doc_id, pos
    and the score snapshot), a result above the lowest positive one that got none itself is 0. The
    lowest position comes from a grouped maximum, so a very active group is combined before any shuffle.
    With ``corpus`` all ten ranking features are computed, category matches from ``profiles``; without it the five that
    the log holds itself.
    """
    keys = ["uid", "query"]
    snapshot = ["bm25_score", "quality_score", "freshness_score", "click_count", "like_count"]
    snapshot += [c for c in ("recall_source",) if c in event_log.columns]
    positive = F.col("event_type").isin("click", "like", "share")
    label = F.when(positive, 1).when(F.col("event_type") == "dismiss", 0)
    logged = event_log.withColumn("label", label).filter(F.col("label").isNotNull())
    rows = logged.select(*keys, "doc_id", F.col("result_pos").alias("pos"), *snapshot, "label")
    if shown is not None:
        won = logged.filter(F.col("label") == 1)
        lowest = won.groupBy(*keys).agg(F.max("result_pos").alias("_lowest"))
        skipped = (
            shown.join(lowest, keys)
            .filter(F.col("pos") < F.col("_lowest"))
            .join(logged.select(*keys, "doc_id").distinct(), [*keys, "doc_id"], "left_anti")
            .select(*keys, "doc_id", "pos", *snapshot, F.lit(0).alias("label"))
        )
        rows = rows.unionByName(skipped)
    scores = {"bm25": F.col("bm25_score"), "quality": F.col("quality_score"), "freshness": F.col("freshness_score")}
    rows = rows.withColumns(scores).drop("bm25_score", "quality_score", "freshness_score")
    if corpus is None:
        own = feature_columns()
        logged_only = ("f_bm25", "f_quality", "f_freshness", "f_log_click", "f_log_like")
        return rows.withColumns({f: own[f] for f in logged_only}).select(*keys, "doc_id", "pos", "label", *logged_only)
    # Every distinct query is tokenised once.
    asked = rows.select("query").distinct().withColumn("terms", tokens("query"))
    rows = rows.join(asked, "query").join(corpus.select("doc_id", "title", "category"), "doc_id", "left")
    if profiles is None:
        rows = rows.withColumn("category_weights", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(profiles.select("uid", "category_weights"), "uid", "left")
    if "recall_source" not in rows.columns:
        rows = rows.withColumn("recall_source", F.lit(""))
    return rows.na.fill("", ["title", "category"]).withColumns(feature_columns()).select(*keys, "doc_id", "pos", "label", *LTR_FEATURES)


@dataclass(frozen=True)
class RankModel:
    """A sum of regression trees over the columns ``features``."""

    features: tuple[str, ...]
    trees: tuple[DecisionTreeRegressionModel, ...]
    rate: float

    def score(self, df: DataFrame, out: str = "model_score") -> DataFrame:
        """``df`` with the raw ranking score."""
        filled = [F.coalesce(F.col(f), F.lit(0.0)).cast("double") for f in self.features]
        rows = df.withColumn("_features", array_to_vector(F.array(*filled))).withColumn(out, F.lit(0.0))
        for tree in self.trees:
            rows = tree.transform(rows).withColumn(out, F.col(out) + self.rate * F.col("_tree")).drop("_tree")
        return rows.drop("_features")

    def save(self, path: str) -> None:
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree={i}")


def train_ranker(
    training: DataFrame, path: str | None = None, version: int = 1, max_iter: int = 20, rate: float = 0.3, depth: int = 4
) -> RankModel:
    """Boosted trees on list-wise gradients, saved under a version folder when a path is given.

    A row's gradient is its share of its (uid, query) group's positives minus its softmax share of the scores; both
    need two sums per group, so no pairs of rows are formed. Groups without a positive or without a negative say
    nothing about order and are left out.
    """
    names = [f for f in LTR_FEATURES if f in training.columns]
    keys = ["uid", "query"]
    useful = training.groupBy(*keys).agg(F.sum("label").alias("_won"), F.count(F.lit(1)).alias("_n"))
    rows = training.join(useful.filter((F.col("_won") > 0) & (F.col("_won") < F.col("_n"))), keys)
    rows = cut_lineage(rows.select(*keys, "label", "_won", *names))
    model = RankModel(tuple(names), (), rate)
    learner = DecisionTreeRegressor(featuresCol="_features", labelCol="_grad", predictionCol="_tree", maxDepth=depth, seed=7)
    filled = F.array(*[F.coalesce(F.col(f), F.lit(0.0)).cast("double") for f in names])
    for _ in range(max_iter):
        scored = model.score(rows, "_score")
        sums = scored.groupBy(*keys).agg(F.sum(F.exp("_score")).alias("_z"))
        grad = F.col("label") / F.col("_won") - F.exp("_score") / F.col("_z")
        data = scored.join(sums, keys).select(array_to_vector(filled).alias("_features"), grad.alias("_grad"))
        tree = learner.fit(data)
        model = RankModel(model.features, (*model.trees, tree), rate)
    if path is not None:
        model.save(f"{path}/v={version}")
    return model


def ndcg(scored: DataFrame, score: str, k: int = 10) -> DataFrame:
    """(uid, query, ndcg) of every group with a positive label: discounted gains of the ``k`` best by ``score``."""
    keys = ["uid", "query"]
    best = top_k(scored.select(*keys, "doc_id", "label", score), keys, [F.desc(score), F.asc("doc_id")], k, "doc_id", "_r")
    found = best.groupBy(*keys).agg(F.sum(F.col("label") / F.log2(F.col("_r") + 1.0)).alias("_dcg"))
    won = scored.groupBy(*keys).agg(F.sum("label").cast("int").alias("_won")).filter("_won > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("_won", F.lit(k))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    return won.join(found, keys).select(*keys, (F.col("_dcg") / ideal).alias("ndcg"))


def should_train(
    event_log: DataFrame, last_run: int, as_of: int, min_events: int = 500, hours: float = 24
) -> bool:
    """True after ``hours`` since the last run or when ``min_events`` newer events are in the log."""
    if as_of - last_run >= hours * 3600:
        return True
    newer = event_log.filter((F.col("ts") > last_run) & (F.col("ts") <= as_of))
    return newer.limit(min_events).count() >= min_events


# ---------------------------------------------------------------- diversity


def mmr_order(items: Column, lam: Column, k: Column) -> Column:
    """Greedy picks as places in ``items``, an array of (rel, words) in falling relevance.

    The first pick is the most relevant one, every other the best trade-off against the most similar pick so far, of
    equal ones the first. The fold keeps the order so far and every item's closest similarity to a pick, which only the
    last pick can raise.
    """
    none = F.array_repeat(F.lit(0.0), F.size(items))
    start = F.struct(F.array(F.lit(0)).alias("order"), none.alias("closest"))
    steps = F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(k, F.size(items))))

    def step(state: Column, n: Column) -> Column:
        last = F.get(items, F.element_at(state["order"], -1))
        closest = F.transform(state["closest"], lambda c, i: F.greatest(c, jaccard(F.get(items, i)["words"], last["words"])))
        moved = F.struct(state["order"].alias("order"), closest.alias("closest"))
        return F.when(n > F.least(k, F.size(items)), state).otherwise(_picked(moved))

    def _picked(state: Column) -> Column:
        def gain(c: Column, i: Column) -> Column:
            return F.when(~F.array_contains(state["order"], i), lam * F.get(items, i)["rel"] - (1 - lam) * c)

        gains = F.transform(state["closest"], gain)
        best = (F.array_position(gains, F.array_max(gains)) - 1).cast("int")
        return F.struct(F.concat(state["order"], F.array(best)).alias("order"), state["closest"].alias("closest"))

    return F.aggregate(steps, start, step)["order"]


def rerank_mmr(
    cands: DataFrame, lam: float = 0.7, top_k_: int = 20, max_candidates: int = 100
) -> DataFrame:
    """Diversity rerank of each query's best ``max_candidates`` (a stage parameter, not a skew guard).

    Columns ``mmr_lambda`` / ``mmr_top_k``, if present, override the defaults per query. Adds
    ``position`` from 1. Each pick depends on the earlier ones, so a query's short list is one array that is
    folded; only ids, scores and title words are in it.
    """
    relevance = F.when(F.col("fine_score") > 0, F.col("fine_score")).otherwise(F.col("coarse_score"))
    rows = cands.withColumn("_rel", relevance)
    rows = top_k(rows, ["query_id"], [F.desc("_rel"), F.asc("doc_id")], max_candidates, "doc_id", "_in")
    lam_col = F.coalesce(F.col("mmr_lambda"), F.lit(lam)) if "mmr_lambda" in cands.columns else F.lit(lam)
    k_col = F.coalesce(F.col("mmr_top_k"), F.lit(top_k_)) if "mmr_top_k" in cands.columns else F.lit(top_k_)
    item = F.struct("_in", F.col("_rel").cast("double").alias("rel"), title_words("title").alias("words"), "doc_id")
    lists = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.any_value(lam_col.cast("double")).alias("_lam"),
        F.any_value(k_col.cast("int")).alias("_k"),
    )
    picks = (
        lists.withColumn("_order", mmr_order(F.col("_items"), F.col("_lam"), F.col("_k")))
        .select("query_id", "_items", F.posexplode("_order").alias("_at", "_place"))
        .select("query_id", F.get("_items", F.col("_place"))["doc_id"].alias("doc_id"), (F.col("_at") + 1).cast("int").alias("position"))
    )
    return rows.drop("_in", "_rel").join(picks, ["query_id", "doc_id"])
