"""Suggestions, hints and trending words (groups G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import behaviour, hints, suggest, trending
from workload import bindings as b
from workload.ctes import AS_OF, VIEWS, hot, low, sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


PRESETS = ", ".join(f"('{w}')" for w in trending.PRESET_WORDS)


def first_kept(distance: int, size: int) -> str:
    """Fold a ranked list ``xs`` of one-element lists: keep words at least ``distance`` edits apart."""
    return f"""list_reduce(xs, lambda acc, x: CASE WHEN len(acc) >= {size} OR len(list_filter(acc, lambda o: levenshtein(o.word, x[1].word) < {distance})) > 0
                 THEN acc ELSE list_concat(acc, x) END)"""


VIEWS.update(
    {
        "lexicon": (
            ("catalog", "qstats"),
            f"""SELECT title AS word, 'title' AS source, greatest(1, click_count)::BIGINT AS freq,
                       CASE WHEN publish_time > 0 THEN publish_time ELSE {AS_OF} END AS last_time, 1.0::DOUBLE AS source_weight
                FROM catalog WHERE title <> ''
                UNION ALL
                SELECT tag, 'tag', greatest(1, click_count // 2)::BIGINT, CASE WHEN publish_time > 0 THEN publish_time ELSE {AS_OF} END, 0.8::DOUBLE
                FROM (SELECT *, unnest(tags) AS tag FROM catalog) WHERE strlen(tag) >= 2
                UNION ALL
                SELECT * FROM (SELECT query, 'user_query', freq, last_time, 1.2::DOUBLE FROM qstats ORDER BY freq DESC, query LIMIT 200)""",
        ),
        "prefixes": (
            ("lexicon",),
            """SELECT * FROM (SELECT prefix, word, source, freq, last_time, source_weight,
                 row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word, source, last_time)::INT AS rank
               FROM (SELECT *, left(word, n) AS prefix FROM (SELECT *, unnest(range(1, length(word) + 1)) AS n FROM lexicon)))
               WHERE rank <= 200""",
        ),
        "asked": (
            (),
            """SELECT p_partkey AS request_id, left(p_name, (1 + p_partkey % 4)::INT) AS prefix FROM part
               UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, left(text, 1) FROM conversations""",
        ),
        "srecall": (
            ("prefixes", "asked"),
            f"""SELECT p.*, strlen(p.prefix) / greatest(1, strlen(word))::DOUBLE AS prefix_match_ratio,
                       ln(1 + freq::DOUBLE) / ln(1 + greatest(1, MAX(freq) OVER (PARTITION BY p.prefix))::DOUBLE) AS freq_norm,
                       exp(-0.099::DOUBLE * greatest(0, ({AS_OF} - last_time) / 86400.0::DOUBLE)) AS freshness
                FROM prefixes p WHERE rank <= 50 AND prefix IN (SELECT prefix FROM asked WHERE prefix <> '')""",
        ),
        "sscore": (
            ("srecall",),
            """SELECT *, prefix_match_ratio * 0.3::DOUBLE + cover * 0.3::DOUBLE + edit_sim * 0.2::DOUBLE + source_weight * 0.2::DOUBLE AS relevance
               FROM (SELECT *, 1.0::DOUBLE AS cover, 1.0::DOUBLE AS edit_sim FROM srecall) WHERE length(word) BETWEEN 2 AND 20""",
        ),
        "sranked": (
            ("sscore",),
            """SELECT *, round((relevance * 0.5::DOUBLE + freq_norm * 0.3::DOUBLE + freshness * 0.2::DOUBLE) * source_weight, 6) AS score FROM sscore""",
        ),
        "sources": (
            (),
            f"""SELECT p_partkey AS source_id, p_partkey AS doc_id, COALESCE(m.text, '') AS query
                FROM part LEFT JOIN benchmark m ON m.item_id = p_partkey % (SELECT COUNT(*) FROM benchmark)""",
        ),
        "ctags": (("catalog",), "SELECT doc_id, n, unnest(ts) AS tag FROM (SELECT doc_id, list_distinct(tags) AS ts, len(list_distinct(tags)) AS n FROM catalog)"),
        "htags": (
            ("ctags", "catalog"),
            """SELECT source_id, c.title AS word, MAX(j) AS tag_overlap FROM (
                 SELECT a.doc_id AS source_id, b.doc_id AS other, COUNT(*) / (a.n + b.n - COUNT(*))::DOUBLE AS j
                 FROM ctags a JOIN ctags b ON a.tag = b.tag AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n) p
               JOIN catalog c ON c.doc_id = p.other WHERE j > 0.1 AND c.title <> '' GROUP BY 1, 2""",
        ),
        "hcat": (
            ("catalog",),
            f"""SELECT s.doc_id AS source_id, c.title AS word, MAX(round({hot('c.click_count', 'c.like_count')}, 6)) AS category_heat
                FROM catalog s JOIN catalog c ON s.category = c.category AND s.doc_id <> c.doc_id WHERE c.title <> '' GROUP BY 1, 2""",
        ),
        "cotop": (
            ("cooccur",),
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY co_count DESC, dst)::INT AS rank FROM cooccur) WHERE rank <= 20",
        ),
        "hco": (
            ("cotop", "catalog"),
            """SELECT src AS source_id, title AS word, ln(1 + MAX(co_count)::DOUBLE) AS cooccur_score
               FROM cotop JOIN catalog ON dst = doc_id WHERE title <> '' GROUP BY 1, 2""",
        ),
        "hq": (
            ("sources", "qstats"),
            f"""SELECT source_id, word, ln(1 + freq::DOUBLE) * 0.05::DOUBLE AS query_score FROM (
                  SELECT s.source_id, s.query, t.query AS word, t.freq, row_number() OVER (PARTITION BY source_id ORDER BY t.freq DESC, t.query) AS rn
                  FROM sources s JOIN qstats t ON starts_with(hex({low('t.query')}), left(hex({low('s.query')}), 12)) WHERE s.query <> '')
                WHERE rn <= 15 AND word <> query""",
        ),
        "hmerged": (
            ("htags", "hcat", "hco", "hq", "sources"),
            """SELECT * FROM (
                 SELECT w.source_id, w.word, s.query,
                        CASE WHEN t.word IS NOT NULL THEN 'tag_match' WHEN c.word IS NOT NULL THEN 'category_hot' WHEN o.word IS NOT NULL THEN 'cooccur' ELSE 'query_expand' END AS source,
                        round(CASE WHEN t.word IS NOT NULL THEN tag_overlap * 0.3::DOUBLE + tag_overlap * 0.4::DOUBLE
                             WHEN c.word IS NOT NULL THEN category_heat * 0.1::DOUBLE * 0.3::DOUBLE + category_heat * 0.05::DOUBLE
                             WHEN o.word IS NOT NULL THEN cooccur_score * 0.5::DOUBLE * 0.3::DOUBLE + cooccur_score * 0.12::DOUBLE
                             ELSE query_score * 0.3::DOUBLE END, 6) AS score
                 FROM (SELECT source_id, word FROM htags UNION SELECT source_id, word FROM hcat UNION SELECT source_id, word FROM hco UNION SELECT source_id, word FROM hq) w
                 JOIN sources s ON s.source_id = w.source_id
                 LEFT JOIN htags t ON t.source_id = w.source_id AND t.word = w.word
                 LEFT JOIN hcat c ON c.source_id = w.source_id AND c.word = w.word
                 LEFT JOIN hco o ON o.source_id = w.source_id AND o.word = w.word
                 LEFT JOIN hq x ON x.source_id = w.source_id AND x.word = w.word)
               WHERE word <> query AND length(word) BETWEEN 2 AND 30""",
        ),
        "trend_cands": (
            ("catalog", "qstats"),
            f"""SELECT word, source, channel_ord, heat FROM (
                  SELECT query AS word, 'hot' AS source, 0 AS channel_ord, round(freq * exp(-0.099::DOUBLE * greatest(0, ({AS_OF} - last_time) / 86400.0::DOUBLE)), 6) AS heat
                  FROM (SELECT * FROM qstats ORDER BY freq DESC, query LIMIT 30)
                  UNION ALL
                  SELECT title, 'doc_hot', 1, MAX(round(click_count * exp(-0.099::DOUBLE * greatest(0, ({AS_OF} - publish_time) / 86400.0::DOUBLE)), 6))
                  FROM catalog WHERE title <> '' GROUP BY title
                  UNION ALL SELECT w, 'preset', 2, 0.1::DOUBLE FROM (VALUES {PRESETS}) t(w))""",
        ),
    }
)


def stats(spark, d):
    return behaviour.query_stats(b.query_log(spark, d))


def lexicon(spark, d):
    return suggest.build_lexicon(b.catalog(spark, d), stats(spark, d), AS_OF)


def dictionary(spark, d):
    return b.stored(spark, d, "prefixes", lambda: suggest.prefix_dictionary(lexicon(spark, d)))


def asked(spark, d):
    """Prefixes of product names and of utterances, one request each."""
    part = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("request_id"), F.substring(F.col("p_name"), F.lit(1), (1 + F.col("p_partkey") % 4).cast("int")).alias("prefix")
    )
    said = b.table(spark, d, "conversations").select(
        (1000000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.substring("text", 1, 1).alias("prefix")
    )
    return part.unionByName(said)


def sources(spark, d):
    """Every product, with a whole benchmark passage as its query."""
    part = b.table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("doc_id"))
    return b.with_passage(spark, d, part, "doc_id").withColumn("query", F.coalesce("query", F.lit("")))


def cooccur(spark, d):
    return b.stored(spark, d, "cooccur", lambda: behaviour.cooccurrence(b.interactions(spark, d), b.INTERACTION_ORDER))


@query("g1_lexicon", sql("SELECT word, source, freq, last_time, source_weight FROM lexicon", "lexicon"))
def g1(spark, d):
    return lexicon(spark, d)


@query("g2_prefix_dictionary", sql("SELECT prefix, word, source, freq, last_time, rank FROM prefixes", "prefixes"))
def g2(spark, d):
    return suggest.prefix_dictionary(lexicon(spark, d)).select("prefix", "word", "source", "freq", "last_time", "rank")


_R6 = "round(prefix_match_ratio, 6) AS prefix_match_ratio, round(freq_norm, 6) AS freq_norm, round(freshness, 6) AS freshness"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("g3_suggest_recall", sql(f"SELECT prefix, word, source, freq, {_R6} FROM srecall", "srecall"))
def g3(spark, d):
    out = suggest.suggest_recall(asked(spark, d), dictionary(spark, d), AS_OF)
    return rounded(out, "prefix_match_ratio", "freq_norm", "freshness").select(
        "prefix", "word", "source", "freq", "prefix_match_ratio", "freq_norm", "freshness"
    )


@query("g4_suggest_score", sql("SELECT prefix, word, source, freq, last_time, cover, edit_sim, round(relevance, 6) AS relevance FROM sscore", "sscore"))
def g4(spark, d):
    out = suggest.suggest_score(suggest.suggest_recall(asked(spark, d), dictionary(spark, d), AS_OF))
    return rounded(out, "relevance").select("prefix", "word", "source", "freq", "last_time", "cover", "edit_sim", "relevance")


VIEWS["misspelt"] = (
    (),
    f"""SELECT *, strlen(prefix) / greatest(1, strlen(word))::DOUBLE AS prefix_match_ratio FROM (
          SELECT DISTINCT word, unnest([{low('left(word, 5)')}, upper(left(word, 5)), left(word, 1) || substr(word, 3, 4), substr(word, 2, 5), left(other, 6), '##' || left(word, 1)]) AS prefix
          FROM (SELECT p.p_name AS word, COALESCE(n.p_name, '') AS other FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1)) WHERE prefix <> ''""",
)


@query(
    "g4_score_misspelt",
    sql(
        """WITH s AS (SELECT *, len(list_filter(string_split(prefix, ''), lambda c: contains(word, c))) / strlen(prefix)::DOUBLE AS cover,
                         1 - levenshtein(prefix, left(word, strlen(prefix)::INT)) / greatest(strlen(prefix), strlen(left(word, strlen(prefix)::INT)))::DOUBLE AS edit_sim FROM misspelt)
           SELECT prefix, word, round(cover, 6) AS cover, round(edit_sim, 6) AS edit_sim,
                  round(prefix_match_ratio * 0.3::DOUBLE + cover * 0.3::DOUBLE + edit_sim * 0.2::DOUBLE + 0.2::DOUBLE, 6) AS relevance
           FROM s WHERE NOT (cover < 0.2 AND edit_sim < 0.3) AND length(word) BETWEEN 2 AND 20""",
        "misspelt",
    ),
)
def g4_misspelt(spark, d):
    """Relevance of product names to prefixes that differ in case, miss a letter, or belong to another name."""
    part = b.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("word"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("word").alias("other"))
    named = part.join(after, "p_partkey", "left").na.fill("", ["other"])
    w = F.col("word")
    forms = F.array(
        F.lower(w.substr(1, 5)), F.upper(w.substr(1, 5)), F.concat(w.substr(1, 1), w.substr(3, 4)), w.substr(2, 5),
        F.col("other").substr(1, 6), F.concat(F.lit("##"), w.substr(1, 1)),
    )
    cands = named.select("word", F.explode(forms).alias("prefix")).filter("prefix <> ''").distinct().withColumns(
        {"prefix_match_ratio": F.octet_length("prefix") / F.greatest(F.lit(1), F.octet_length("word")), "source_weight": F.lit(1.0)}
    )
    return rounded(suggest.suggest_score(cands), "cover", "edit_sim", "relevance").select("prefix", "word", "cover", "edit_sim", "relevance")


def _suggest_sql(fold: str | None) -> str:
    item = "{word: word, source: source, score: score}"
    kept = "xs" if fold is None else fold
    wrap = item if fold is None else f"[{item}]"
    return sql(
        f"""WITH l AS (SELECT prefix, list({wrap} ORDER BY score DESC, word, source, last_time, freq) AS xs FROM sranked GROUP BY prefix),
                 k AS (SELECT prefix, {kept} AS kept FROM l),
                 o AS (SELECT a.request_id, a.prefix, unnest(range(1, least(10, len(k.kept)) + 1)) AS position, k.kept FROM asked a JOIN k ON k.prefix = a.prefix)
            SELECT request_id, prefix, position::INT AS position, kept[position].word AS word, kept[position].source AS source, kept[position].score AS score,
                   strlen(prefix)::INT AS highlight_len FROM o WHERE kept[position].score >= 0.01""",
        "sranked",
    )


@query("g5_suggest_all", _suggest_sql(None))
def g5_all(spark, d):
    return suggest.suggest(asked(spark, d), dictionary(spark, d), AS_OF, dedup_distance=0)


@query("g5_suggest", _suggest_sql(first_kept(2, 50)))
def g5(spark, d):
    return suggest.suggest(asked(spark, d), dictionary(spark, d), AS_OF)


@query(
    "h1_hint_tags",
    sql(
        """SELECT source_id, word, round(tag_overlap, 6) AS tag_overlap FROM htags
           QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY tag_overlap DESC, word) <= 20""",
        "htags",
    ),
)
def h1(spark, d):
    out = hints.hint_tags(sources(spark, d), b.catalog(spark, d), limit=20)
    return rounded(out, "tag_overlap").select("source_id", "word", "tag_overlap")


@query(
    "h2_hint_category",
    sql(
        """SELECT source_id, word, category_heat, round(category_heat * 0.1::DOUBLE, 6) AS recall_score FROM hcat
           QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY category_heat DESC, word) <= 20""",
        "hcat",
    ),
)
def h2(spark, d):
    return rounded(hints.hint_category(sources(spark, d), b.catalog(spark, d), 20), "recall_score")


@query("h3_hint_cooccur", sql("SELECT source_id, word, round(cooccur_score, 6) AS cooccur_score, round(cooccur_score * 0.5::DOUBLE, 6) AS recall_score FROM hco", "hco"))
def h3(spark, d):
    out = hints.hint_cooccur(sources(spark, d), cooccur(spark, d), b.catalog(spark, d))
    return rounded(out, "cooccur_score", "recall_score")


@query("h4_hint_queries", sql("SELECT source_id, word, round(query_score, 6) AS recall_score FROM hq", "hq"))
def h4(spark, d):
    return rounded(hints.hint_queries(sources(spark, d), stats(spark, d)), "recall_score")


def _hints_sql(fold: str | None) -> str:
    item = "{word: word, source: source, score: score}"
    kept = "xs" if fold is None else fold
    wrap = item if fold is None else f"[{item}]"
    return sql(
        f"""WITH l AS (SELECT source_id, list({wrap} ORDER BY score DESC, word) AS xs FROM hmerged GROUP BY source_id),
                 k AS (SELECT source_id, {kept} AS kept FROM l),
                 o AS (SELECT source_id, kept, unnest(range(1, least(10, len(kept)) + 1)) AS position FROM k)
            SELECT source_id, position::INT AS position, kept[position].word AS word, kept[position].source AS source, kept[position].score AS score FROM o""",
        "hmerged",
    )


def _hints(spark, d, **options):
    return hints.hints(sources(spark, d), b.catalog(spark, d), cooccur(spark, d), stats(spark, d), **options)


@query("h5_hints_all", _hints_sql(None))
def h5_all(spark, d):
    return _hints(spark, d, dedup_distance=0)


@query("h5_hints", _hints_sql(first_kept(3, 10)))
def h5(spark, d):
    return _hints(spark, d)


@query("i1_trending_candidates", sql("SELECT word, source, channel_ord, heat FROM trend_cands", "trend_cands"))
def i1(spark, d):
    return trending.trending_candidates(stats(spark, d), b.catalog(spark, d), AS_OF)


@query(
    "i2_trending",
    sql(
        """SELECT word, arg_min(source, channel_ord) AS source, arg_min(heat, channel_ord) AS heat FROM trend_cands
           WHERE length(word) BETWEEN 2 AND 20 GROUP BY word ORDER BY heat DESC, word LIMIT 6""",
        "trend_cands",
    ),
)
def i2(spark, d):
    return trending.trending(trending.trending_candidates(stats(spark, d), b.catalog(spark, d), AS_OF))
