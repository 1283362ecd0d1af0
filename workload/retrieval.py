"""Recall, ranking and filters (groups D, E, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import behaviour, duplicates, filters, ranking, recall, vector_index, vectors
from workload import bindings as b
from workload.ctes import AS_OF, VIEWS, hot, sql, tok
from workload.prep import scratch

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


HOT_HOURS = 24 * 90
N_VEC = "sqrt(list_sum(list_transform(embedding, lambda x: x * x)))"

VIEWS.update(
    {
        "vtop": (
            ("vec",),
            f"""SELECT query_id, doc_id, score FROM (
                  SELECT a.doc_id AS query_id, v.doc_id, round(list_dot_product(a.embedding, v.embedding) / (a.n * v.n), 6) AS score,
                         row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_dot_product(a.embedding, v.embedding) / (a.n * v.n), 6) DESC, v.doc_id) AS rn
                  FROM (SELECT *, {N_VEC} AS n FROM vec) a, (SELECT *, {N_VEC} AS n FROM vec) v
                  WHERE round(list_dot_product(a.embedding, v.embedding) / (a.n * v.n), 6) >= 0.3) WHERE rn <= 20""",
        ),
        "hot100": (
            ("corpus",),
            f"""SELECT doc_id, round({hot('click_count', 'like_count')}, 6) AS hot_score FROM corpus
                WHERE publish_time BETWEEN {AS_OF - HOT_HOURS * 3600} AND {AS_OF}
                ORDER BY 2 DESC, 1 LIMIT 100""",
        ),
        "hot_recall": (("hot100", "q"), "SELECT query_id, doc_id, hot_score AS recall_score FROM q, hot100"),
        "hist": (
            ("click_hist", "q", "corpus"),
            """SELECT query_id, doc_id, 1.0::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY pos) AS recall_score FROM (
                 SELECT q.query_id, h.doc_id, h.pos FROM q
                 JOIN (SELECT uid, doc_id, MIN(pos) AS pos FROM (
                         SELECT uid, unnest(ids) AS doc_id, unnest(range(len(ids))) + CASE WHEN kind = 'like' THEN 1000 ELSE 0 END AS pos
                         FROM click_hist) GROUP BY 1, 2) h ON h.uid = q.uid
                 JOIN corpus c ON c.doc_id = h.doc_id
                 WHERE len(q.terms) = 0 OR c.category = q.category
                    OR len(list_filter(q.terms, lambda t: contains(c.title, t) OR contains(c.category, t))) > 0
                 QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY h.pos) <= 200)""",
        ),
        "channels": (
            ("text_recall", "hist", "hot_recall"),
            """SELECT 0 AS ord, 'inverted_index' AS channel, query_id, doc_id, recall_score FROM text_recall
               UNION ALL SELECT 1, 'user_history', query_id, doc_id, recall_score FROM hist
               UNION ALL SELECT 2, 'hot_content', query_id, doc_id, recall_score FROM hot_recall""",
        ),
        "prof": (
            ("active", "weights"),
            """SELECT a.*, w.cw FROM active a LEFT JOIN (
                 SELECT uid, map_from_entries(list({k: category, v: weight})) AS cw FROM weights GROUP BY uid) w ON w.uid = a.uid""",
        ),
        "ltr": (
            ("coarse", "q", "weights"),
            """SELECT c.*, tanh(len(q.terms) / 5.0::DOUBLE) AS f_query_len, c.bm25 AS f_bm25, c.quality AS f_quality,
                      c.freshness AS f_freshness, tanh(ln(1 + c.click_count::DOUBLE) / 5) AS f_log_click,
                      tanh(ln(1 + c.like_count::DOUBLE) / 5) AS f_log_like, tanh(strlen(c.title) / 30.0::DOUBLE) AS f_title_len,
                      tanh(len(list_filter(q.terms, lambda t: t <> '' AND (contains(c.title, t) OR contains(c.category, t)))) / 3.0::DOUBLE) AS f_term_match,
                      least(1.0::DOUBLE, COALESCE(w.weight, 0) * 2) AS f_category_match,
                      CASE c.recall_source WHEN 'vector' THEN 1 / 3.0::DOUBLE WHEN 'hot_content' THEN 2 / 3.0::DOUBLE WHEN 'user_history' THEN 1 ELSE 0 END AS f_source
               FROM coarse c JOIN q ON q.query_id = c.query_id
               LEFT JOIN weights w ON w.uid = q.uid AND w.category = c.category AND c.category <> ''""",
        ),
        "rules": (
            ("ltr",),
            """SELECT *, (tanh((
                   CASE WHEN f_bm25 > 0.5 OR f_term_match > 0.5 THEN CASE WHEN f_quality > 0.3 THEN 0.8::DOUBLE ELSE 0.5 END
                        WHEN f_bm25 > 0.2 THEN CASE WHEN f_freshness > 0.5 THEN 0.4::DOUBLE ELSE 0.2 END
                        ELSE CASE WHEN f_log_click > 0.3 THEN 0.1::DOUBLE ELSE -0.1 END END
                 + CASE WHEN f_quality > 0.6 THEN CASE WHEN f_category_match > 0.3 OR f_log_like > 0.3 THEN 0.7::DOUBLE ELSE 0.4 END
                        WHEN f_quality > 0.3 THEN CASE WHEN f_bm25 > 0.3 THEN 0.3::DOUBLE ELSE 0.1 END
                        ELSE CASE WHEN f_freshness > 0.7 THEN 0.2::DOUBLE ELSE -0.2 END END
                 + CASE WHEN f_log_click > 0.5 OR f_log_like > 0.5 THEN CASE WHEN f_bm25 > 0.1 THEN 0.6::DOUBLE ELSE 0.3 END
                        WHEN f_freshness > 0.8 THEN 0.3::DOUBLE ELSE -0.1 END) / 3 * 2) + 1) / 2 AS model_score
               FROM ltr""",
        ),
        "fine": (
            ("rules",),
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id)::INT AS fine_rank FROM (
                 SELECT *, CASE WHEN fine_score > 0 THEN fine_score ELSE coarse_score END AS final_score
                 FROM (SELECT *, round(model_score * 0.8::DOUBLE, 6) AS fine_score FROM rules))) WHERE fine_rank <= 100""",
        ),
        "charsets": (
            ("fine",),
            r"""SELECT query_id, doc_id, fine_rank, title,
                       list_sort(list_distinct(regexp_extract_all(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x7F]|[A-Za-z0-9]'))) AS cs
                FROM fine""",
        ),
        "title_pairs": (
            ("charsets",),
            """SELECT * FROM (SELECT x.query_id, x.doc_id AS first_id, y.doc_id AS second_id,
                 len(list_intersect(x.cs, y.cs)) / (len(x.cs) + len(y.cs) - len(list_intersect(x.cs, y.cs)))::DOUBLE AS similarity
               FROM charsets x JOIN charsets y ON x.query_id = y.query_id AND x.fine_rank < y.fine_rank
               WHERE len(x.cs) > 0 AND len(y.cs) > 0) WHERE similarity >= 0.9""",
        ),
    }
)


def text_channel(spark, d) -> DataFrame:
    return recall.recall_text(b.queries(spark, d), b.snapshot(spark, d))


def hot_channel(spark, d) -> DataFrame:
    return recall.recall_hot(b.queries(spark, d), recall.hot_list(b.corpus(spark, d), AS_OF, HOT_HOURS))


def history_channel(spark, d) -> DataFrame:
    return recall.recall_history(b.queries(spark, d), b.user_profiles(spark, d), b.corpus(spark, d))


def channels(spark, d) -> dict[str, DataFrame]:
    return {
        recall.TEXT: text_channel(spark, d),
        recall.HISTORY: history_channel(spark, d),
        recall.HOT: hot_channel(spark, d),
    }


@query(
    "d1_recall_text",
    sql(
        """SELECT query_id, doc_id, round(recall_score, 6) AS recall_score, title, category, click_count, snippet FROM scored""",
        "scored",
    ),
)
def d1(spark, d):
    out = recall.recall_text(b.queries(spark, d), b.snapshot(spark, d), b.corpus(spark, d))
    return out.select("query_id", "doc_id", F.round("recall_score", 6).alias("recall_score"), "title", "category", "click_count", "snippet")


@query("d2_vector_exact", sql("SELECT query_id, doc_id, score FROM vtop", "vtop"))
def d2(spark, d):
    return recall_vectors(spark, d).select("query_id", "doc_id", "score")


def recall_vectors(spark, d):
    return vectors.recall_vector(b.vector_queries(spark, d), b.vectors(spark, d), 20, 0.3)


def recall_cells(spark, d, **options):
    return vector_index.search(b.vector_queries(spark, d), b.vector_cells(spark, d), 20, 0.3, **options)


@query("d3_vector_cells")
def d3(spark, d):
    return recall_cells(spark, d).select("query_id", "doc_id", "score")


@query("d3_cells_all_probed", sql("SELECT query_id, doc_id, score FROM vtop", "vtop"))
def d3_all(spark, d):
    """With every cell probed and every row checked, the stored index gives the exact neighbours."""
    return recall_cells(spark, d, n_probe=1 << 12, checked=1 << 20).select("query_id", "doc_id", "score")


@query(
    "d3_recall_at_10",
    sql(
        """WITH t AS (SELECT query_id, least(10, COUNT(*)) AS n FROM vtop GROUP BY 1)
           SELECT COUNT(*) AS n_queries, SUM(n)::BIGINT AS n_exact, TRUE AS recall_reached FROM t""",
        "vtop",
    ),
)
def d3_recall(spark, d):
    """Share of the ten exact neighbours of every vector that the probed cells give: 0.9 or more."""
    ten = lambda df: df.filter("rank <= 10").select("query_id", "doc_id")
    exact, near = ten(recall_vectors(spark, d)), ten(recall_cells(spark, d))
    hits = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_exact"),
        (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )


@query("d4_hot_list", sql(f"SELECT doc_id, round({hot('click_count', 'like_count')}, 6) AS hot_score FROM corpus WHERE publish_time BETWEEN {AS_OF - HOT_HOURS * 3600} AND {AS_OF} ORDER BY 2 DESC, 1 LIMIT 200", "corpus"))
def d4_list(spark, d):
    return recall.hot_list(b.corpus(spark, d), AS_OF, HOT_HOURS)


@query("d4_recall_hot", sql("SELECT query_id, doc_id, recall_score FROM hot_recall", "hot_recall"))
def d4(spark, d):
    return hot_channel(spark, d).drop("recall_source")


@query("d5_recall_history", sql("SELECT query_id, doc_id, round(recall_score, 6) AS recall_score FROM hist", "hist"))
def d5(spark, d):
    return history_channel(spark, d).select("query_id", "doc_id", F.round("recall_score", 6).alias("recall_score"))


_UNION = """SELECT query_id, doc_id, arg_min(channel, ord) AS recall_source, arg_min(recall_score, ord) AS recall_score
            FROM channels GROUP BY query_id, doc_id"""


@query("d6_union_recall", sql(f"SELECT query_id, doc_id, recall_source, round(recall_score, 6) AS recall_score FROM ({_UNION})", "channels"))
def d6(spark, d):
    return recall.union_recall(channels(spark, d)).withColumn("recall_score", F.round("recall_score", 6))


@query("d6_recall_counts", sql(f"SELECT query_id, recall_source, COUNT(*) AS n FROM ({_UNION}) GROUP BY 1, 2", "channels"))
def d6_counts(spark, d):
    return recall.recall_counts(recall.union_recall(channels(spark, d)))


@query(
    "d7_fuse_rrf",
    sql(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY round(recall_score, 6) DESC, doc_id) AS rk FROM channels),
                f AS (SELECT query_id, doc_id, round(SUM(1.0::DOUBLE / (60 + rk)), 6) AS recall_score, string_agg(channel, ' ' ORDER BY ord) AS recall_source
                      FROM r GROUP BY 1, 2)
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recall_score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 1500""",
        "channels",
    ),
)
def d7(spark, d):
    return recall.fuse_rrf(channels(spark, d))


@query(
    "d8_fuse_weighted",
    sql(
        """WITH p AS (SELECT channel, query_id, MAX(recall_score) AS peak FROM channels GROUP BY 1, 2),
                f AS (SELECT c.query_id, c.doc_id,
                        round(SUM(CASE ord WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3 ELSE 1 END * recall_score / CASE WHEN peak < 1e-6 THEN 1 ELSE peak END), 6) AS recall_score,
                        arg_max(c.channel, ord) AS recall_source
                      FROM channels c JOIN p ON p.channel = c.channel AND p.query_id = c.query_id GROUP BY 1, 2)
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recall_score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 1500""",
        "channels",
    ),
)
def d8(spark, d):
    return recall.fuse_weighted(channels(spark, d), [0.5, 0.3])


# ---------------------------------------------------------------- E


def scored(spark, d) -> DataFrame:
    q, index = b.queries(spark, d), b.snapshot(spark, d)
    cands = recall.enrich(recall.recall_text(q, index, bm25=(1.5, 0.75)), b.corpus(spark, d), recall.NUMBERS)
    return ranking.score_freshness(ranking.score_quality(cands), AS_OF)


def features(spark, d) -> DataFrame:
    ranked = recall.enrich(ranking.coarse_rank(scored(spark, d)), b.corpus(spark, d), ("title", "author", "category", "snippet"))
    return ranking.ltr_features(ranked, b.queries(spark, d), b.user_profiles(spark, d))


def fine(spark, d) -> DataFrame:
    return ranking.fine_rank(ranking.score_rules(features(spark, d)))


@query("e1_bm25", sql("SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM scored", "scored"))
def e1(spark, d):
    cands = recall.recall_text(b.queries(spark, d), b.snapshot(spark, d), bm25=(1.5, 0.75))
    return cands.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query(
    "e1_bm25_offered",
    sql(
        """SELECT h.query_id, h.doc_id, round(COALESCE(m.bm25, 0), 6) AS bm25 FROM hot_recall h
           LEFT JOIN bm25 m ON m.query_id = h.query_id AND m.doc_id = h.doc_id""",
        "hot_recall", "bm25",
    ),
)
def e1_offered(spark, d):
    """BM25 of candidates that another channel offered, matching or not."""
    out = ranking.score_bm25(hot_channel(spark, d), b.queries(spark, d), b.snapshot(spark, d))
    return out.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query(
    "e1_bm25_top10",
    sql(
        """SELECT * FROM (SELECT query_id, doc_id, round(bm25, 6) AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id)::INT AS rank FROM bm25) WHERE rank <= 10""",
        "bm25",
    ),
)
def e1_top(spark, d):
    return recall.search_bm25(b.queries(spark, d), b.snapshot(spark, d), 10)


@query("e2_quality", sql(
    """SELECT doc_id, round(0.3::DOUBLE * tanh(ln(1 + click_count::DOUBLE) / 5) + 0.4::DOUBLE * tanh(ln(1 + like_count::DOUBLE) / 5)
          + 0.3::DOUBLE * least(greatest(quality_score, 0), 1), 6) AS quality FROM corpus""", "corpus"))
def e2(spark, d):
    return ranking.score_quality(b.corpus(spark, d)).select("doc_id", F.round("quality", 6).alias("quality"))


@query("e3_freshness", sql(
    f"""SELECT doc_id, round(CASE WHEN age >= 0 AND age <= 365 THEN exp(-0.01::DOUBLE * age) ELSE 0 END, 6) AS freshness
        FROM (SELECT doc_id, ({AS_OF} - publish_time) / 86400.0::DOUBLE AS age FROM corpus)""", "corpus"))
def e3(spark, d):
    return ranking.score_freshness(b.corpus(spark, d), AS_OF).select("doc_id", F.round("freshness", 6).alias("freshness"))


@query("e4_coarse_rank", sql(
    """SELECT query_id, doc_id, coarse_score, coarse_rank::INT AS coarse_rank, round(bm25, 6) AS bm25, round(quality, 6) AS quality,
              round(freshness, 6) AS freshness FROM coarse""", "coarse"))
def e4(spark, d):
    out = ranking.coarse_rank(scored(spark, d))
    debug = {n: F.round(F.col("debug_scores")[n], 6).alias(n) for n in ("bm25", "quality", "freshness")}
    return out.select("query_id", "doc_id", "coarse_score", "coarse_rank", *debug.values())


_FEATURES = ", ".join(f"round({f}, 6) AS {f}" for f in ranking.LTR_FEATURES)


@query("e5_ltr_features", sql(f"SELECT query_id, doc_id, {_FEATURES} FROM ltr", "ltr"))
def e5(spark, d):
    return features(spark, d).select("query_id", "doc_id", *[F.round(f, 6).alias(f) for f in ranking.LTR_FEATURES])


@query("e6_score_rules", sql("SELECT query_id, doc_id, round(model_score, 6) AS model_score FROM rules", "rules"))
def e6(spark, d):
    return ranking.score_rules(features(spark, d)).select("query_id", "doc_id", F.round("model_score", 6).alias("model_score"))


def event_log(spark, d) -> DataFrame:
    return behaviour.build_event_log(b.events(spark, d), b.corpus(spark, d))


def shown_results(spark, d) -> DataFrame:
    """Results shown to users: every view is one shown result at its position."""
    log = event_log(spark, d)
    return log.filter(F.col("event_type") == "view").select(
        "uid", "query", "doc_id", F.col("result_pos").alias("pos"), "bm25_score", "quality_score", "freshness_score", "click_count", "like_count", "recall_source"
    )


def training_rows(spark, d) -> DataFrame:
    """All ten features of every labelled row, written once per application."""
    build = lambda: ranking.training_set(event_log(spark, d), shown_results(spark, d), b.corpus(spark, d), b.user_profiles(spark, d))
    return b.stored(spark, d, "training", build)


def held_out() -> Column:
    """One user in five is kept from training."""
    return F.col("uid") % 5 == 1


def trained(spark, d, path: str | None = None) -> ranking.RankModel:
    return ranking.train_ranker(training_rows(spark, d).filter(~held_out()), path, max_iter=5)


@query("e7_score_model")
def e7(spark, d):
    out = ranking.score_model(features(spark, d), trained(spark, d))
    return out.select("query_id", "doc_id", F.round("model_score", 6).alias("model_score"))


@query(
    "e7_model_coverage",
    sql("SELECT query_id, COUNT(*) AS n_scored, TRUE AS in_range FROM ltr GROUP BY 1", "ltr"),
)
def e7_coverage(spark, d):
    """Every coarse result gets a model score between 0 and 1."""
    out = ranking.score_model(features(spark, d), trained(spark, d))
    inside = F.min((F.col("model_score") > 0) & (F.col("model_score") < 1))
    return out.groupBy("query_id").agg(F.count("model_score").alias("n_scored"), inside.alias("in_range"))


@query("e8_fine_rank", sql("SELECT query_id, doc_id, fine_score, final_score, fine_rank FROM fine", "fine"))
def e8(spark, d):
    return fine(spark, d).select("query_id", "doc_id", "fine_score", "final_score", "fine_rank")


_TRAIN = f"""WITH log AS (SELECT e.uid, COALESCE(e.query, '') AS query, e.doc_id, e.result_pos AS pos, e.event_type, e.bm25_score, e.quality_score, e.freshness_score,
                 COALESCE(c.click_count, 0) AS click_count, COALESCE(c.like_count, 0) AS like_count, e.recall_source,
                 CASE WHEN event_type IN ('click', 'like', 'share') THEN 1 WHEN event_type = 'dismiss' THEN 0 END AS label
               FROM ev e LEFT JOIN corpus c ON c.doc_id = e.doc_id),
             low AS (SELECT uid, query, MAX(pos) AS lowest FROM log WHERE label = 1 GROUP BY 1, 2),
             rows_ AS (SELECT *, label AS y FROM log WHERE label IS NOT NULL
               UNION ALL
               SELECT s.*, 0 FROM log s JOIN low ON low.uid = s.uid AND low.query = s.query
               WHERE s.event_type = 'view' AND s.pos < low.lowest AND NOT EXISTS (
                 SELECT 1 FROM log x WHERE x.uid = s.uid AND x.query = s.query AND x.doc_id = s.doc_id AND x.label IS NOT NULL)),
             asked_terms AS (SELECT query, {tok("query")} AS terms FROM (SELECT DISTINCT query FROM rows_)),
             full_ AS (SELECT r.*, t.terms, COALESCE(c.title, '') AS title, COALESCE(c.category, '') AS category, w.weight
               FROM rows_ r JOIN asked_terms t ON t.query = r.query LEFT JOIN corpus c ON c.doc_id = r.doc_id
               LEFT JOIN weights w ON w.uid = r.uid AND w.category = c.category AND c.category <> '')
             SELECT uid, query, doc_id, pos, y AS label, round(tanh(len(terms) / 5.0::DOUBLE), 6) AS f_query_len, round(bm25_score, 6) AS f_bm25,
                    round(quality_score, 6) AS f_quality, round(freshness_score, 6) AS f_freshness,
                    round(tanh(ln(1 + click_count::DOUBLE) / 5), 6) AS f_log_click, round(tanh(ln(1 + like_count::DOUBLE) / 5), 6) AS f_log_like,
                    round(tanh(strlen(title) / 30.0::DOUBLE), 6) AS f_title_len,
                    round(tanh(len(list_filter(terms, lambda t: t <> '' AND (contains(title, t) OR contains(category, t)))) / 3.0::DOUBLE), 6) AS f_term_match,
                    round(least(1.0::DOUBLE, COALESCE(weight, 0) * 2), 6) AS f_category_match,
                    round(CASE recall_source WHEN 'vector' THEN 1 / 3.0::DOUBLE WHEN 'hot_content' THEN 2 / 3.0::DOUBLE WHEN 'user_history' THEN 1 ELSE 0 END, 6) AS f_source
             FROM full_"""


@query("e9_training_set", sql(_TRAIN, "ev", "corpus", "weights"))
def e9(spark, d):
    out = training_rows(spark, d)
    return out.select("uid", "query", "doc_id", "pos", "label", *[F.round(c, 6).alias(c) for c in ranking.LTR_FEATURES])


@query(
    "e10_train_ranker",
    sql(
        f"""SELECT 5 AS trees, CASE WHEN grp % 5 = 1 THEN 'held out' ELSE 'training' END AS part, COUNT(*) AS n_groups, TRUE AS ndcg_in_range, 10 AS n_features
            FROM (SELECT uid AS grp, query FROM ({_TRAIN.replace('WITH log', 'WITH log', 1)}) GROUP BY 1, 2 HAVING SUM(label) > 0) GROUP BY 1, 2""",
        "ev", "corpus", "weights",
    ),
)
def e10(spark, d):
    """Train when due on four users in five, save, and judge the order of both parts' groups by NDCG."""
    if not ranking.should_train(event_log(spark, d), b.ANCHOR, b.AS_OF):
        return spark.createDataFrame([], "trees int, part string, n_groups bigint, ndcg_in_range boolean, n_features int")
    model = trained(spark, d, scratch(spark, "ranker"))
    scores = ranking.ndcg(model.score(training_rows(spark, d)), "model_score")
    part = F.when(held_out(), "held out").otherwise("training")
    return scores.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.min(F.col("ndcg").between(0, 1 + 1e-9)).alias("ndcg_in_range")
    ).withColumns({"trees": F.lit(len(model.trees)), "n_features": F.lit(len(model.features))})


_MMR = """WITH RECURSIVE items AS (
             SELECT query_id, list({rel: rel, words: words, doc_id: doc_id, fine: fine_score} ORDER BY rel DESC, doc_id) AS xs FROM (
               SELECT query_id, doc_id, fine_score, final_score AS rel, list_distinct(TOKENS) AS words FROM fine) GROUP BY query_id),
           picks AS (
             SELECT query_id, [1]::BIGINT[] AS ord, list_transform(xs, lambda x: 0::DOUBLE) AS closest, 1 AS step FROM items
             UNION ALL
             SELECT query_id, list_append(ord, list_position(gains, list_max(gains))::BIGINT), closest, step FROM (
               SELECT query_id, ord, closest, step,
                      list_transform(closest, lambda c, i: CASE WHEN list_contains(ord, i) THEN NULL ELSE 0.7::DOUBLE * xs[i].rel - (1 - 0.7::DOUBLE) * c END) AS gains
               FROM (
                 SELECT p.query_id, p.ord, i.xs, p.step + 1 AS step,
                        list_transform(p.closest, lambda c, n: greatest(c, CASE WHEN len(i.xs[n].words) = 0 OR len(i.xs[p.ord[-1]].words) = 0 THEN 0 ELSE
                          len(list_intersect(i.xs[n].words, i.xs[p.ord[-1]].words)) / (len(i.xs[n].words) + len(i.xs[p.ord[-1]].words)
                            - len(list_intersect(i.xs[n].words, i.xs[p.ord[-1]].words)))::DOUBLE END)) AS closest
                 FROM picks p JOIN items i ON i.query_id = p.query_id WHERE p.step < least(20, len(i.xs)))))
           SELECT query_id, xs[place].doc_id AS doc_id, position::INT AS position, xs[place].fine AS fine_score FROM (
             SELECT p.query_id, i.xs, unnest(p.ord) AS place, unnest(range(1, len(p.ord) + 1)) AS position
             FROM picks p JOIN items i ON i.query_id = p.query_id WHERE p.step = least(20, len(i.xs)))""".replace("TOKENS", tok("title"))


@query("e11_rerank_mmr", "WITH RECURSIVE " + sql(_MMR.replace("WITH RECURSIVE", "WITH", 1), "fine").removeprefix("WITH "))
def e11(spark, d):
    return ranking.rerank_mmr(fine(spark, d)).select("query_id", "doc_id", "position", "fine_score")


# ---------------------------------------------------------------- F


@query(
    "f1_dedup_results",
    sql(
        """WITH l AS (SELECT query_id, list([{id: doc_id, cs: cs}] ORDER BY fine_rank) AS xs FROM charsets GROUP BY query_id),
                k AS (SELECT query_id, list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: len(o.cs) > 0 AND len(x[1].cs) > 0 AND
                        len(list_intersect(o.cs, x[1].cs)) / (len(o.cs) + len(x[1].cs) - len(list_intersect(o.cs, x[1].cs)))::DOUBLE >= 0.9)) > 0
                        THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)
           SELECT query_id, (unnest(kept)).id AS doc_id FROM k""",
        "charsets",
    ),
)
def f1(spark, d):
    return filters.dedup_results(fine(spark, d)).select("query_id", "doc_id")


@query("f2_dup_title_pairs", sql("SELECT query_id, first_id, second_id, round(similarity, 6) AS similarity FROM title_pairs", "title_pairs"))
def f2(spark, d):
    return filters.dup_title_pairs(fine(spark, d)).withColumn("similarity", F.round("similarity", 6))


VIEWS["corpus_sets"] = (
    ("corpus",),
    r"""SELECT MIN(doc_id) AS set_id, cs, COUNT(*) AS n_docs FROM (
          SELECT doc_id, list_sort(list_distinct(regexp_extract_all(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x7F]|[A-Za-z0-9]'))) AS cs
          FROM corpus) WHERE len(cs) > 0 GROUP BY cs""",
)
VIEWS["set_pairs"] = (
    ("corpus_sets",),
    """SELECT first_id, second_id, similarity FROM (
         SELECT x.set_id AS first_id, y.set_id AS second_id,
                len(list_intersect(x.cs, y.cs)) / (len(x.cs) + len(y.cs) - len(list_intersect(x.cs, y.cs)))::DOUBLE AS similarity
         FROM corpus_sets x JOIN corpus_sets y ON x.set_id < y.set_id) WHERE similarity >= 0.9""",
)


@query("f2_corpus_title_pairs", sql("SELECT first_id, second_id, round(similarity, 6) AS similarity FROM set_pairs", "set_pairs"))
def f2_pairs(spark, d):
    """Similar titles in the whole corpus, between the first documents of their character sets."""
    pairs = duplicates.similar_sets(duplicates.title_sets(b.corpus(spark, d)))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(
    "f2_corpus_survivors",
    "WITH RECURSIVE " + sql(
        r"""WITH reach AS (
              SELECT set_id AS node, set_id AS root FROM corpus_sets
              UNION
              SELECT e.b, r.root FROM reach r JOIN (SELECT first_id AS a, second_id AS b FROM set_pairs UNION ALL SELECT second_id, first_id FROM set_pairs) e ON e.a = r.node)
            SELECT set_id AS doc_id FROM corpus_sets JOIN (SELECT node, MIN(root) AS root FROM reach GROUP BY node) ON node = set_id WHERE root = set_id
            UNION ALL SELECT doc_id FROM corpus
            WHERE len(regexp_extract_all(COALESCE(title, ''), '[^\x00-\x7F]|[A-Za-z0-9]')) = 0""",
        "set_pairs", "corpus",
    ).removeprefix("WITH "),
)
def f2_survivors(spark, d):
    """One document per group of connected similar titles."""
    return duplicates.remove_near_duplicates(b.corpus(spark, d)).select("doc_id")


@query("f3_filter_quality", sql("SELECT query_id, doc_id FROM scored WHERE quality_score >= 0.5 AND click_count >= 1 AND strlen(snippet) >= 100", "scored"))
def f3(spark, d):
    cands = recall.recall_text(b.queries(spark, d), b.snapshot(spark, d), b.corpus(spark, d))
    return filters.filter_quality(cands, 0.5, 1, 100).select("query_id", "doc_id")


_SPAM = """title = '' OR (strlen(left(title, 1)) = 1 AND left(title, 5) = repeat(left(title, 1), 5))
           OR (strlen(title) > 5 AND length(regexp_replace(title, '[^A-Z]', '', 'g')) > strlen(title) * 0.1::DOUBLE)"""


@query("f4_filter_spam", sql(f"SELECT doc_id, title FROM corpus WHERE NOT ({_SPAM})", "corpus"))
def f4(spark, d):
    return filters.filter_spam(b.corpus(spark, d), 0.1).select("doc_id", "title")


@query("f5_filter_blacklist", sql(
    """SELECT doc_id, author FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
       AND author NOT IN (SELECT min(source) FROM documents GROUP BY lang)""", "corpus"))
def f5(spark, d):
    toxic = b.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("entry"))
    authors = b.table(spark, d, "documents").groupBy("lang").agg(F.min("source").alias("s"))
    listed = toxic.unionByName(authors.select(F.concat(F.lit("author:"), "s").alias("entry")))
    return filters.filter_blacklist(b.corpus(spark, d), listed).select("doc_id", "author")


def rule_lists(spark, d):
    """Brands as requests, their product names as result words scored by sales."""
    return b.catalog(spark, d).groupBy(F.col("author").alias("request_id"), F.col("title").alias("word")).agg(
        F.sum("click_count").cast("double").alias("score")
    )


def rule_table(spark, d):
    """Rules derived from the products: block the first name, block names starting like the last
    one, boost and demote names, force two words."""
    names = b.table(spark, d, "part").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"), F.min_by("p_name", "p_partkey").alias("first"))
    rule = lambda o, action, pattern, position=0, weight=0.0: F.struct(
        F.lit(o).alias("ord"), F.lit(action).alias("action"), pattern.alias("pattern"), F.lit(position).alias("position"),
        F.lit(weight).alias("weight"), F.concat(F.lit("rule"), F.lit(str(o))).alias("reason"),
    )
    lo, hi, first = F.col("lo"), F.col("hi"), F.col("first")
    head = F.concat(F.lit("^"), F.split(hi, " ")[0])
    rules = F.array(
        rule(0, "BLOCK", lo), rule(1, "FORCE_TOP", F.concat(F.lit("new "), first), 1), rule(2, "BLOCK", head),
        rule(3, "BOOST", first, 0, 0.5), rule(4, "DEMOTE", F.lit("red ring"), 0, 0.25), rule(5, "FORCE_TOP", lo, -1),
    )
    return names.select(F.explode(rules).alias("r")).select("r.*")


VIEWS["names"] = ((), "SELECT min(p_name) AS lo, max(p_name) AS hi, arg_min(p_name, p_partkey) AS first FROM part")
VIEWS["rlists"] = (
    ("catalog", "names"),
    """SELECT author AS request_id, title AS word, round(SUM(click_count) * CASE WHEN title = any_value(n.first) THEN 1.5::DOUBLE ELSE 1 END
              * CASE WHEN title = 'red ring' THEN 0.75::DOUBLE ELSE 1 END, 6) AS score
       FROM catalog, names n GROUP BY author, title""",
)


@query(
    "f6_apply_rules",
    sql(
        r"""WITH kept AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, word) AS rn FROM rlists r, names n
                          WHERE word <> n.lo AND NOT regexp_matches(word, n.lo)),
                 placed AS (SELECT request_id, word, score, CASE WHEN rn >= 2 THEN rn + 1 ELSE rn END AS rn FROM kept
                            UNION ALL SELECT DISTINCT request_id, 'new ' || n.first, NULL::DOUBLE, 2 FROM rlists, names n),
                 left_ AS (SELECT p.*, row_number() OVER (PARTITION BY request_id ORDER BY rn) AS k FROM placed p, names n
                           WHERE NOT regexp_matches(word, '^' || string_split(n.hi, ' ')[1]))
            SELECT request_id, (k + 1)::INT AS position, word, score FROM left_
            UNION ALL SELECT DISTINCT request_id, 1, n.lo, NULL::DOUBLE FROM rlists, names n""",
        "rlists",
    ),
)
def f6(spark, d):
    return filters.apply_rules(rule_lists(spark, d), rule_table(spark, d))[0]


@query(
    "f6_removed_words",
    sql(
        r"""SELECT request_id, word, 'BLOCKED' AS outcome, CASE WHEN word = n.lo OR regexp_matches(word, n.lo) THEN 'rule0' ELSE 'rule2' END AS reason
            FROM rlists, names n WHERE word = n.lo OR regexp_matches(word, n.lo) OR regexp_matches(word, '^' || string_split(n.hi, ' ')[1])""",
        "rlists",
    ),
)
def f6_removed(spark, d):
    return filters.apply_rules(rule_lists(spark, d), rule_table(spark, d))[1]
