"""Behaviour aggregates, profiles, features, experiments, vector tables (groups J, K, L, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import behaviour, duplicates, experiments, features, profiles, recall, textprep, vectors
from workload import bindings as b
from workload.ctes import AS_OF, VIEWS, asked, low, sql, tok

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- J


def stats(spark, d):
    return behaviour.query_stats(b.query_log(spark, d))


@query("j1_query_stats", sql("SELECT query, freq, last_time, source, first_time FROM qstats", "qstats"))
def j1(spark, d):
    return stats(spark, d)


@query("j1_merge_query_stats", sql("SELECT query, freq, last_time, source, first_time FROM qstats", "qstats"))
def j1_merge(spark, d):
    log = b.query_log(spark, d)
    even = F.col("uid") % 2 == 0
    return behaviour.merge_query_stats(behaviour.query_stats(log.filter(even)), behaviour.query_stats(log.filter(~even)))


_NAMES = "SELECT p_name AS query, COUNT(*) AS freq, MAX(p_partkey) AS last_time, 'catalog' AS source, MIN(p_partkey) AS first_time FROM part GROUP BY 1"


def name_stats(spark, d):
    part = b.table(spark, d, "part").groupBy(F.col("p_name").alias("query"))
    return part.agg(
        F.count(F.lit(1)).alias("freq"), F.max("p_partkey").alias("last_time"), F.lit("catalog").alias("source"), F.min("p_partkey").alias("first_time")
    )


@query(
    "j2_seed_query_stats",
    sql(f"SELECT * FROM qstats UNION ALL BY NAME SELECT * FROM ({_NAMES}) WHERE query NOT IN (SELECT query FROM qstats)", "qstats"),
)
def j2(spark, d):
    return behaviour.seed_query_stats(stats(spark, d), name_stats(spark, d))


@query("j3_top_queries", sql("SELECT query, freq, last_time, source FROM qstats ORDER BY freq DESC, query LIMIT 50", "qstats"))
def j3(spark, d):
    return behaviour.top_queries(stats(spark, d), 50).drop("first_time")


@query(
    "j3_top_by_source",
    sql("SELECT query, freq, source FROM qstats QUALIFY row_number() OVER (PARTITION BY source ORDER BY freq DESC, query) <= 10", "qstats"),
)
def j3_source(spark, d):
    return behaviour.top_queries(stats(spark, d), 10, by="source").select("query", "freq", "source")


@query(
    "j3_top_by_prefix",
    sql(
        f"""SELECT p.prefix, s.query, s.freq FROM (SELECT DISTINCT left(text, 2) AS prefix FROM conversations) p
            JOIN qstats s ON starts_with({low('s.query')}, {low('p.prefix')}) WHERE p.prefix <> ''
            QUALIFY row_number() OVER (PARTITION BY p.prefix ORDER BY s.freq DESC, s.query) <= 10""",
        "qstats",
    ),
)
def j3_prefix(spark, d):
    prefixes = b.table(spark, d, "conversations").select(F.substring("text", 1, 2).alias("prefix"))
    return behaviour.top_queries(stats(spark, d), 10, prefixes=prefixes).select("prefix", "query", "freq")


@query("j3_query_count", sql("SELECT COUNT(*) AS n FROM qstats", "qstats"))
def j3_count(spark, d):
    return behaviour.query_count(stats(spark, d))


def edges(spark, d):
    return behaviour.cooccurrence(b.interactions(spark, d), b.INTERACTION_ORDER)


_EDGES = "SELECT src, dst, co_count, last_time FROM cooccur"


@query("j4_cooccurrence", sql(_EDGES, "cooccur"))
def j4(spark, d):
    return edges(spark, d)


@query("j4_merge_cooccurrence", sql(_EDGES, "cooccur"))
def j4_merge(spark, d):
    inter = b.interactions(spark, d)
    even = F.col("uid") % 2 == 0
    old = behaviour.cooccurrence(inter.filter(even), b.INTERACTION_ORDER)
    return behaviour.merge_cooccurrence(old, behaviour.cooccurrence(inter.filter(~even), b.INTERACTION_ORDER))


@query(
    "j5_top_cooccur",
    sql("SELECT *, row_number() OVER (PARTITION BY src ORDER BY co_count DESC, dst)::INT AS rank FROM cooccur QUALIFY rank <= 20", "cooccur"),
)
def j5(spark, d):
    return behaviour.top_cooccur(edges(spark, d))


# ---------------------------------------------------------------- K

VIEWS.update(
    {
        "all_ev": (
            ("ev", "qlog"),
            """SELECT event_id, uid, doc_id, event_type, ts, query, duration_ms FROM ev
               UNION ALL SELECT 1000000000 + (uid * 1000 + ts) * 100000 + pos, uid, NULL, 'search', ts, query, NULL FROM qlog""",
        ),
        "asked_hist": (
            ("qlog",),
            """SELECT uid, list(query ORDER BY ts, event_id) AS qs FROM (
                 SELECT *, 1000000000 + (uid * 1000 + ts) * 100000 + pos AS event_id FROM qlog WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts DESC, pos DESC) <= 50)
               GROUP BY uid""",
        ),
        "prof_rows": (
            ("all_ev", "click_hist", "asked_hist"),
            f"""SELECT u.*, COALESCE(array_to_string(q.qs, ' '), '') AS query_history, COALESCE(array_to_string(c.ids, ' '), '') AS click_doc_ids,
                       COALESCE(array_to_string(l.ids, ' '), '') AS like_doc_ids, c.ids AS cids, l.ids AS lids, q.qs
                FROM (SELECT uid, SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS total_clicks,
                             SUM(CASE WHEN event_type = 'like' THEN 1 ELSE 0 END)::BIGINT AS total_likes,
                             least(30, COUNT(DISTINCT CASE WHEN ts // 86400 > {AS_OF // 86400 - 30} AND ts // 86400 <= {AS_OF // 86400} THEN ts // 86400 END))::INT AS active_days
                      FROM all_ev GROUP BY uid) u
                LEFT JOIN click_hist c ON c.uid = u.uid AND c.kind = 'click' LEFT JOIN click_hist l ON l.uid = u.uid AND l.kind = 'like'
                LEFT JOIN asked_hist q ON q.uid = u.uid""",
        ),
        "kw": (
            (),
            f"""SELECT min(w) AS keyword, lang AS category FROM (SELECT lang, {asked('text')} AS w FROM documents) GROUP BY lang
                UNION ALL SELECT max(w), lang FROM (SELECT lang, {asked('text')} AS w FROM documents) GROUP BY lang""",
        ),
        "links": (
            (),
            """SELECT lang AS category, nxt AS linked FROM (SELECT lang, lead(lang) OVER (ORDER BY lang) AS nxt FROM (SELECT DISTINCT lang FROM documents)) WHERE nxt IS NOT NULL
               UNION ALL SELECT DISTINCT lang, 'lang-' || lang FROM documents""",
        ),
        "refreshed": (
            ("prof_rows", "weights", "kw", "links"),
            """SELECT uid, category, weight / greatest(1, SUM(weight) OVER (PARTITION BY uid)) AS weight FROM (
                 SELECT uid, category, CASE WHEN MIN(own) = 1 THEN SUM(w) ELSE least(1, SUM(w) + SUM(a)) END AS weight FROM (
                   SELECT uid, category, w, 0.0::DOUBLE AS a, 1 AS own FROM own_w
                   UNION ALL SELECT o.uid, l.linked, 0, o.w * 0.3::DOUBLE, 0 FROM own_w o JOIN links l ON l.category = o.category) GROUP BY uid, category)""",
        ),
        "own_w": (
            ("prof_rows", "weights", "kw"),
            """SELECT uid, category, w3 AS w FROM (SELECT *, pow(0.85::DOUBLE, ns) * w2 + 0.05::DOUBLE * (1 - pow(0.85::DOUBLE, ns)) AS w3 FROM (
                 SELECT *, pow(0.7::DOUBLE, nl) * w1 + 0.8::DOUBLE * (1 - pow(0.7::DOUBLE, nl)) AS w2 FROM (
                   SELECT *, pow(0.7::DOUBLE, nc) * w0 + 0.5::DOUBLE * (1 - pow(0.7::DOUBLE, nc)) AS w1 FROM (
                     SELECT uid, category, SUM(w) AS w0, SUM(nc) AS nc, SUM(nl) AS nl, SUM(ns) AS ns FROM (
                       SELECT w.uid, w.category, w.weight * pow(0.95::DOUBLE, 30 - p.active_days) AS w, 0 AS nc, 0 AS nl, 0 AS ns FROM weights w JOIN prof_rows p ON p.uid = w.uid
                       UNION ALL SELECT p.uid, d.lang, 0, 1, 0, 0 FROM (SELECT uid, unnest(cids) AS x FROM prof_rows) p JOIN documents d ON d.doc_id = p.x
                       UNION ALL SELECT p.uid, d.lang, 0, 0, 1, 0 FROM (SELECT uid, unnest(lids) AS x FROM prof_rows) p JOIN documents d ON d.doc_id = p.x
                       UNION ALL SELECT p.uid, kw.category, 0, 0, 0, 1 FROM (SELECT uid, unnest(qs) AS x FROM prof_rows) p JOIN kw ON contains(p.x, kw.keyword))
                     GROUP BY uid, category)))) """,
        ),
        "ema": (
            ("clicks", "vec"),
            """SELECT uid, embedding, CASE WHEN back = MAX(back) OVER (PARTITION BY uid) THEN pow(0.5::DOUBLE, back) ELSE 0.5 * pow(0.5::DOUBLE, back) END AS share FROM (
                 SELECT e.uid, v.embedding, row_number() OVER (PARTITION BY e.uid ORDER BY e.ts DESC, e.event_id DESC) - 1 AS back
                 FROM clicks e JOIN vec v ON v.doc_id = e.doc_id)""",
        ),
    }
)
VIEWS["refreshed"] = (("own_w", "links"), VIEWS["refreshed"][1])


def all_events(spark, d):
    """User events plus one search event per logged query."""
    log = b.query_log(spark, d)
    asked = log.select(
        (1000000000 + (F.col("uid") * 1000 + F.col("ts")) * 100000 + F.col("pos")).alias("event_id"), "uid", "ts", "query", F.lit("search").alias("event_type")
    )
    return b.events(spark, d).unionByName(asked, allowMissingColumns=True)


def build_profiles(spark, d):
    none = profiles.empty_profiles(spark, "bigint", "bigint")
    return profiles.update_profiles(none, all_events(spark, d), b.corpus(spark, d), AS_OF)


def full_profiles(spark, d):
    return b.stored(spark, d, "profiles-with-searches", lambda: build_profiles(spark, d))


def flat_profiles(df):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return df.select(
        "uid", "total_clicks", "total_likes", F.col("active_days_last_30").alias("active_days"),
        join("query_history"), join("click_doc_ids"), join("like_doc_ids"),
    )


def weight_rows(df):
    return df.select("uid", F.explode("category_weights").alias("category", "weight")).withColumn("weight", F.round("weight", 6))


_SIMPLE = """SELECT uid, d.lang AS category, round(least(1.0::DOUBLE, SUM(CASE event_type WHEN 'click' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END)), 6) AS weight
             FROM ev JOIN documents d ON d.doc_id = ev.doc_id WHERE event_type IN ('click', 'like') GROUP BY 1, 2"""


@query("k1_profiles_simple", sql(
    f"""SELECT w.*, p.click_doc_ids, p.like_doc_ids, p.total_clicks, p.total_likes FROM ({_SIMPLE}) w JOIN prof_rows p ON p.uid = w.uid""",
    "prof_rows"))
def k1(spark, d):
    none = profiles.empty_profiles(spark, "bigint", "bigint")
    out = profiles.update_profiles_simple(none, b.events(spark, d), b.corpus(spark, d), AS_OF)
    return weight_rows(out).join(flat_profiles(out).drop("query_history", "active_days"), "uid")


_PROF = "uid, total_clicks, total_likes, active_days, query_history, click_doc_ids, like_doc_ids"


@query("k2_profiles", sql(f"SELECT {_PROF} FROM prof_rows", "prof_rows"))
def k2(spark, d):
    return flat_profiles(build_profiles(spark, d))


@query("k2_profile_weights", sql("SELECT uid, category, round(weight, 6) AS weight FROM weights", "weights"))
def k2_weights(spark, d):
    return weight_rows(full_profiles(spark, d))


@query("k2_profiles_in_two_steps", sql(f"SELECT {_PROF} FROM prof_rows", "prof_rows"))
def k2_steps(spark, d):
    """The second half of the time line on top of profiles from the first half."""
    ev, corpus = all_events(spark, d), b.corpus(spark, d)
    middle = b.ANCHOR + 5 * b.DAY
    none = profiles.empty_profiles(spark, "bigint", "bigint")
    first = profiles.update_profiles(none, ev.filter(F.col("ts") < middle), corpus, AS_OF)
    return flat_profiles(profiles.update_profiles(first, ev.filter(F.col("ts") >= middle), corpus, AS_OF))


def keyword_table(spark, d):
    seen = b.table(spark, d, "documents").select("lang", b.asked_words().alias("w"))
    ends = seen.groupBy("lang").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return ends.select(F.explode(F.array("lo", "hi")).alias("keyword"), F.col("lang").alias("category"))


def link_table(spark, d):
    langs = b.table(spark, d, "documents").select(F.col("lang").alias("category")).distinct()
    following = langs.withColumn("linked", F.lead("category").over(Window.orderBy("category"))).filter("linked IS NOT NULL")
    return following.unionByName(langs.withColumn("linked", F.concat(F.lit("lang-"), "category")))


@query("k3_refresh_interests", sql("SELECT uid, category, round(weight, 6) AS weight FROM refreshed", "refreshed"))
def k3(spark, d):
    out = profiles.refresh_interests(full_profiles(spark, d), b.corpus(spark, d), keyword_table(spark, d), link_table(spark, d))
    return rounded(out, "weight")


@query(
    "k4_interest_vectors",
    sql("SELECT uid, i - 1 AS pos, round(SUM(embedding[i] * share), 6) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM ema) GROUP BY uid, i", "ema"),
)
def k4(spark, d):
    clicks = b.events(spark, d).filter(F.col("event_type") == "click")
    out = profiles.interest_vectors(clicks, b.vectors(spark, d))
    return out.select("uid", F.posexplode("embedding").alias("pos", "v")).select("uid", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


# ---------------------------------------------------------------- L


def _any(x: str, ws) -> str:
    return f"regexp_matches({x}, '{'|'.join(ws)}')"


_LOW = low("raw")
_CN, _EN = r"regexp_matches(raw, '[\x{4E00}-\x{9FFF}]')", "regexp_matches(raw, '[A-Za-z]')"
_L1 = rf"""WITH u AS (SELECT conv_id * 1000 + turn AS query_id, text AS raw, {tok('text')} AS terms FROM conversations),
  t AS (SELECT *, CASE WHEN {_any(_LOW, features.NAVIGATIONAL)} THEN 1.0::DOUBLE WHEN {_any(_LOW, features.TRANSACTIONAL)} THEN 3 ELSE 2 END AS query_type, len(terms) AS n FROM u)
  SELECT query_id, strlen(raw)::DOUBLE AS query_length, n::DOUBLE AS term_count,
    round(CASE WHEN n > 0 THEN list_sum(list_transform(terms, lambda x: strlen(x))) / n::DOUBLE ELSE 0 END, 6) AS avg_term_length,
    {_CN}::INT::DOUBLE AS has_chinese, {_EN}::INT::DOUBLE AS has_english, regexp_matches(raw, '[0-9]')::INT::DOUBLE AS has_number,
    regexp_matches(raw, '[^A-Za-z0-9 ]')::INT::DOUBLE AS has_special_char, query_type,
    CASE WHEN {_CN} AND {_EN} THEN 3.0::DOUBLE WHEN {_CN} THEN 1 WHEN {_EN} THEN 2 ELSE 0 END AS language,
    round(CASE WHEN n > 0 THEN (len(list_distinct(terms)) / n::DOUBLE + least(n / 10.0::DOUBLE, 1)) / 2 ELSE 0 END, 6) AS query_complexity,
    (strlen(raw) < 2 OR {_any(_LOW, features.HOT_WORDS)})::INT::DOUBLE AS is_hot_query, {_any(_LOW, features.TIME_WORDS)}::INT::DOUBLE AS time_sensitivity,
    CASE query_type WHEN 1 THEN 0.2::DOUBLE WHEN 3 THEN 0.5 ELSE 1 END AS expected_result_count FROM t"""


@query("l1_query_features", _L1)
def l1(spark, d):
    said = b.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("raw"))
    out = features.query_features(textprep.tokenize_queries(said, "raw"))
    return rounded(out, "avg_term_length", "query_complexity")


_L2 = f"""WITH c AS (SELECT s.*, q.terms, q.category AS want, ({AS_OF} - publish_time) / 86400.0::DOUBLE AS age, {low("title || ' ' || snippet")} AS txt,
              strlen(title) / NULLIF(strlen(snippet), 0)::DOUBLE AS ratio FROM scored s JOIN q ON q.query_id = s.query_id)
  SELECT query_id, doc_id, quality_score,
    CASE WHEN publish_time <= 0 THEN 0.5::DOUBLE WHEN age <= 7 THEN 1 WHEN age <= 30 THEN 0.5 WHEN age <= 365 THEN 0.2 ELSE 0.1 END AS freshness,
    round(CASE WHEN click_count > 0 THEN ln(1 + click_count::DOUBLE) ELSE 0 END, 6) AS click_count, round(CASE WHEN like_count > 0 THEN ln(1 + like_count::DOUBLE) ELSE 0 END, 6) AS like_count,
    strlen(title)::DOUBLE AS title_length,
    CASE WHEN category = '' OR want = '' THEN 0.5::DOUBLE WHEN category = want THEN 1 WHEN contains(category, want) OR contains(want, category) THEN 0.7 ELSE 0 END AS category_match,
    round(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(txt, t))) / len(terms)::DOUBLE ELSE 0 END, 6) AS keyword_coverage,
    round(least((ln(1 + click_count::DOUBLE) + ln(1 + like_count::DOUBLE)) / 20, 1), 6) AS doc_popularity,
    CASE WHEN strlen(author) > 10 THEN 0.8::DOUBLE WHEN strlen(author) > 5 THEN 0.5 ELSE 0.3 END AS authority,
    CASE WHEN strlen(snippet) = 0 THEN 0.5::DOUBLE WHEN ratio > 0.1 AND ratio < 0.3 THEN 1 WHEN ratio > 0.05 AND ratio < 0.5 THEN 0.7 ELSE 0.4 END AS readability FROM c"""


@query("l2_doc_features", sql(_L2, "scored", "q"))
def l2(spark, d):
    q = b.queries(spark, d)
    cands = recall.recall_text(q, b.snapshot(spark, d), b.corpus(spark, d))
    out = features.doc_features(cands, q, AS_OF)
    return rounded(out, "click_count", "like_count", "keyword_coverage", "doc_popularity")


_USER = f"""WITH e AS (SELECT uid, COUNT(*) AS k, SUM(CASE WHEN weight > 1e-9 THEN -weight * ln(weight) ELSE 0 END) AS entropy FROM weights GROUP BY uid)
  SELECT q.query_id, CASE WHEN p.uid IS NULL OR active_days < 1 THEN 0.0::DOUBLE WHEN active_days >= 20 THEN 1 WHEN active_days >= 10 THEN 0.7 WHEN active_days >= 3 THEN 0.4 ELSE 0.2 END AS user_activity,
    round(CASE WHEN e.k IS NULL THEN 0 WHEN e.k = 1 THEN 1 ELSE 1 - e.entropy / ln(e.k) END, 6)::DOUBLE AS interest_concentration,
    COALESCE(total_clicks, 0)::DOUBLE AS history_click_count, COALESCE(len(cids), 0)::DOUBLE AS history_view_count, COALESCE(active_days, 0)::DOUBLE AS retention_days,
    0.5::DOUBLE AS user_ctr, 0.5::DOUBLE AS avg_dwell_time, CASE WHEN p.uid IS NULL OR active_days <= 3 THEN 1.0::DOUBLE ELSE 0 END AS is_new_user,
    CASE WHEN total_clicks > 100 AND total_likes > 20 THEN 1.0::DOUBLE ELSE 0 END AS is_high_value_user, 0.0::DOUBLE AS device_type, 0.0::DOUBLE AS time_preference,
    round(CASE WHEN p.uid IS NULL THEN 0.5 WHEN w.weight IS NULL THEN 0 ELSE least(1, w.weight) END, 6)::DOUBLE AS category_match
  FROM q LEFT JOIN prof_rows p ON p.uid = q.uid LEFT JOIN e ON e.uid = q.uid LEFT JOIN weights w ON w.uid = q.uid AND w.category = q.category"""


@query("l3_user_features", sql(_USER, "q", "prof_rows", "weights"))
def l3(spark, d):
    out = features.user_features(b.queries(spark, d), full_profiles(spark, d))
    return rounded(out, "interest_concentration", "category_match")


_ALL = [*features.QUERY_FEATURES, "not_computed"]


@query(
    "l4_feature_store",
    f"""SELECT query_id::VARCHAR AS entity_id, 'query' AS entity_type,
          array_to_string([{', '.join(f'round({n} * 1000)::BIGINT' for n in features.QUERY_FEATURES)}, -1000], ' ') AS milli FROM ({_L1})""",
)
def l4(spark, d):
    long = features.to_long(l1(spark, d), "query", "query_id", features.QUERY_FEATURES)
    vec = features.feature_vectors(long, _ALL, default=-1.0)
    milli = F.transform("features", lambda x: F.round(x * 1000).cast("long").cast("string"))
    return vec.select("entity_id", "entity_type", F.array_join(milli, " ").alias("milli"))


# ---------------------------------------------------------------- M

HASH_SQL = "list_reduce(list_transform(string_split(uid, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (h * 33 + x) % 4294967296, 5381::BIGINT) % 100"
VIEWS.update(
    {
        "exps": (
            (),
            """SELECT *, floor(round(SUM(traffic) OVER (ORDER BY ord) * 100, 6)) AS e_end, floor(round((SUM(traffic) OVER (ORDER BY ord) - traffic) * 100, 6)) AS e_start
               FROM (SELECT r_regionkey AS ord, r_name AS name, 0.10::DOUBLE + r_regionkey * 0.05::DOUBLE AS traffic, '0.' || (r_regionkey + 3) AS lambda_value FROM region)""",
        ),
        "buckets": ((), f"SELECT uid, CASE WHEN uid <> '' THEN ({HASH_SQL})::INT END AS bucket FROM (SELECT c_name AS uid FROM customer UNION ALL SELECT '')"),
        "assigned": (
            ("exps", "buckets"),
            "SELECT b.uid, b.bucket, e.name AS experiment, e.lambda_value FROM buckets b LEFT JOIN exps e ON b.bucket >= e.e_start AND b.bucket < e.e_end",
        ),
    }
)


def users(spark, d):
    named = b.table(spark, d, "customer").select(F.col("c_name").alias("uid"))
    return named.unionByName(named.agg(F.lit("").alias("uid")))


@query("m1_assign_experiments", sql("SELECT uid, bucket, experiment FROM assigned", "assigned"))
def m1(spark, d):
    return experiments.assign_experiments(users(spark, d), b.experiment_table(spark, d))


@query(
    "m2_resolve_params",
    sql(
        """SELECT uid, 'mmr_lambda' AS key, COALESCE(lambda_value, '0.7') AS value FROM assigned
           UNION ALL SELECT uid, 'coarse_top_k', (SELECT COUNT(*) FROM nation)::VARCHAR FROM assigned""",
        "assigned",
    ),
)
def m2(spark, d):
    count = b.table(spark, d, "nation").agg(F.count(F.lit(1)).cast("string").alias("n"))
    pairs = F.array(
        F.struct(F.lit("mmr_lambda").alias("key"), F.lit("0.7").alias("value")), F.struct(F.lit("coarse_top_k").alias("key"), F.col("n").alias("value"))
    )
    defaults = count.select(F.explode(pairs).alias("p")).select("p.*")
    return experiments.resolve_params(users(spark, d), b.experiment_table(spark, d), defaults)


@query("m3_fingerprint", r"SELECT doc_id, md5(text || chr(31) || lang) AS md5, sha1(text || chr(31) || lang) AS sha1 FROM documents")
def m3(spark, d):
    return experiments.fingerprint(b.table(spark, d, "documents"), ["text", "lang"]).select("doc_id", "md5", "sha1")


@query(
    "m3_remove_duplicates",
    "SELECT doc_id FROM (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY coalesce(text, ''), coalesce(lang, '')) AS first FROM documents) WHERE doc_id = first",
)
def m3_removed(spark, d):
    """Documents left when copies of text and language go."""
    return duplicates.remove_exact_duplicates(b.table(spark, d, "documents"), ["text", "lang"]).select("doc_id")


def neighbours(spark, d):
    """Every vector under the id before it, so that a join on the id pairs neighbours."""
    v = b.vectors(spark, d)
    return v.select((F.col("doc_id") - 1).alias("doc_id"), "embedding")


_PAIR = "SELECT a.doc_id, a.embedding AS x, b.embedding AS y FROM vec a JOIN vec b ON b.doc_id = a.doc_id + 1"


@query(
    "m4_vector_join",
    sql(
        f"""SELECT doc_id, true AS same_dim, round(list_dot_product(x, y), 6) AS dot, round(list_cosine_similarity(x, y), 6) AS cosine,
               round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))), 6) AS l1, round(list_distance(x, y), 6) AS l2 FROM ({_PAIR})""",
        "vec",
    ),
)
def m4(spark, d):
    out = vectors.vector_join(b.vectors(spark, d).drop("label"), neighbours(spark, d), "doc_id")
    return rounded(out, "dot", "cosine", "l1", "l2")


@query(
    "m4_combine_vectors",
    sql(
        f"""WITH p AS ({_PAIR}), c AS (SELECT doc_id, list_transform(range(1, 65), lambda i: x[i] - 0.5::DOUBLE * y[i]) AS z FROM p),
                 n AS (SELECT doc_id, z, sqrt(list_sum(list_transform(z, lambda v: v * v))) AS n FROM c)
            SELECT doc_id, i - 1 AS pos, round(3 * z[i] / n, 6) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM n)""",
        "vec",
    ),
)
def m4_combine(spark, d):
    mixed = vectors.combine_vectors(b.vectors(spark, d).drop("label"), neighbours(spark, d), "doc_id", "subtract", 0.5)
    out = vectors.scale_vectors(vectors.normalize_vectors(mixed), 3.0)
    return out.select("doc_id", F.posexplode("embedding").alias("pos", "v")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query(
    "m4_vector_norms",
    sql("SELECT doc_id, round(list_sum(list_transform(embedding, lambda x: abs(x))), 6) AS norm1, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS norm2 FROM vec", "vec"),
)
def m4_norms(spark, d):
    return rounded(vectors.vector_norms(b.vectors(spark, d)), "norm1", "norm2").select("doc_id", "norm1", "norm2")


@query(
    "m5_vector_stats",
    sql(
        """SELECT doc_id, round(AVG(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(MIN(v), 6) AS min, round(MAX(v), 6) AS max
           FROM (SELECT doc_id, unnest(embedding) AS v FROM vec) GROUP BY doc_id""",
        "vec",
    ),
)
def m5(spark, d):
    out = vectors.vector_stats(b.vectors(spark, d))
    return rounded(out, "mean", "std", "min", "max").select("doc_id", "mean", "std", "min", "max")


@query(
    "m5_group_dim_stats",
    sql(
        """SELECT label, (i - 1)::INT AS dim, round(AVG(v), 6) AS mean, round(COALESCE(stddev_samp(v), 0), 6) AS std, round(MIN(v), 6) AS min, round(MAX(v), 6) AS max
           FROM (SELECT label, i, embedding[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec)) GROUP BY 1, 2""",
        "vec",
    ),
)
def m5_group(spark, d):
    return rounded(vectors.vector_stats(b.vectors(spark, d), "label"), "mean", "std", "min", "max")
