"""Sources, query and document preparation, text index (groups A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import behaviour, index, textprep, vectors
from lodestone.session import checkpoint_dir
from lodestone.sources import corpus as docs
from lodestone.sources import snapshots
from workload import bindings as b
from workload.ctes import sql, tok

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def flat_corpus(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "title", "author", "category", "publish_time", F.concat_ws(",", "tags").alias("tags"),
        "quality_score", "click_count", "like_count", F.col("content_length").cast("long").alias("content_length"),
        F.md5("content").alias("content_md5"),
    )


FLAT = """doc_id, title, author, category, publish_time, array_to_string(tags, ',') AS tags, quality_score, click_count,
          like_count, content_length::BIGINT AS content_length, md5(content) AS content_md5"""


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("a1_corpus_json", sql(f"SELECT {FLAT} FROM corpus", "corpus"))
def a1(spark, d):
    path = scratch(spark, "json")
    b.corpus(spark, d).drop("content_length").write.json(path)
    back = docs.read_corpus_json(spark, path, multi_line=False)
    return flat_corpus(back.withColumn("doc_id", F.col("doc_id").cast("long")))


@query("a2_tags_csv", sql("SELECT doc_id, array_to_string(tags, ',') AS tags, len(tags)::INT AS n_tags FROM corpus", "corpus"))
def a2_tags(spark, d):
    back = docs.csv_to_tags(docs.tags_to_csv(b.corpus(spark, d)))
    return docs.tags_to_csv(back.withColumn("n_tags", F.size("tags"))).select("doc_id", "tags", "n_tags")


@query("a2_corpus_lookup", sql(f"SELECT {FLAT} FROM corpus WHERE doc_id IN (SELECT item_id FROM benchmark)", "corpus"))
def a2_lookup(spark, d):
    ids = b.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return flat_corpus(docs.corpus_lookup(b.corpus(spark, d), ids))


@query(
    "a3_upsert_corpus",
    sql(
        f"""SELECT {FLAT} FROM (
          SELECT * REPLACE ('v' || version || ' ' || title AS title) FROM (
            SELECT c.*, turn AS version, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS rn
            FROM corpus c JOIN conversations ON conv_id = doc_id) WHERE rn = 1
          UNION ALL BY NAME
          SELECT * FROM corpus WHERE doc_id NOT IN (SELECT conv_id FROM conversations))""",
        "corpus",
    ),
)
def a3(spark, d):
    corpus = b.corpus(spark, d)
    turns = b.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"))
    changes = corpus.join(turns, "doc_id").withColumn(
        "title", F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(" "), "title")
    )
    return flat_corpus(docs.upsert_corpus(corpus, changes))


@query(
    "a4_delete_docs",
    sql(
        """SELECT 'corpus' AS kind, COUNT(*) AS n, SUM(doc_id)::BIGINT AS ids FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels)
           UNION ALL SELECT 'postings', COUNT(*), SUM(doc_id)::BIGINT FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM labels)
           UNION ALL SELECT 'vectors', COUNT(*), SUM(doc_id)::BIGINT FROM vec WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "postings", "vec",
    ),
)
def a4(spark, d):
    kept = docs.delete_docs(
        b.corpus(spark, d), b.snapshot(spark, d).postings, b.vectors(spark, d), b.table(spark, d, "labels")
    )
    out = None
    for kind, df in zip(("corpus", "postings", "vectors"), kept):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
        out = row if out is None else out.unionByName(row)
    return out


@query("a5_index_snapshot", sql("SELECT term, doc_id, tf, field_weight, doc_len FROM postings", "postings"))
def a5(spark, d):
    path = scratch(spark, "index")
    snapshots.write_index(index.build_index(b.corpus(spark, d)), path, b.AS_OF)
    return snapshots.read_index(spark, path).postings.select("term", "doc_id", "tf", "field_weight", "doc_len")


@query(
    "a6_vector_snapshot",
    sql("SELECT doc_id, i - 1 AS pos, round(embedding[i], 6) AS value FROM (SELECT doc_id, embedding, unnest(range(1, 65)) AS i FROM vec)", "vec"),
)
def a6(spark, d):
    path = scratch(spark, "vectors")
    snapshots.write_vectors(b.vectors(spark, d), path, 64)
    back = snapshots.read_vectors(spark, path, 64)
    return back.select("doc_id", F.posexplode("embedding").alias("pos", "v")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value")
    )


@query(
    "a6_vector_versions",
    "SELECT v.version, label, COUNT(*) AS n FROM embeddings, (SELECT unnest([1, 2])::BIGINT AS version) v WHERE version = 1 OR label % 2 = 0 GROUP BY 1, 2",
)
def a6_versions(spark, d):
    """A second version is published while the first stays readable."""
    path = scratch(spark, "vector-versions")
    table = b.vectors(spark, d)
    snapshots.write_vectors(table, path, 64)
    old = snapshots.read_vectors(spark, path, 64)
    snapshots.write_vectors(table.filter(F.col("label") % 2 == 0), path, 64)
    new = snapshots.read_vectors(spark, path, 64)
    both = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    return both.groupBy(F.col("version").cast("bigint").alias("version"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a7_event_log",
    sql(
        """SELECT e.event_id, e.uid, e.doc_id, e.event_type, COALESCE(e.query, '') AS query, e.result_pos,
                  COALESCE(e.duration_ms, 0) AS duration_ms, e.bm25_score, 0.0::DOUBLE AS fine_score,
                  COALESCE(c.click_count, 0) AS click_count, COALESCE(c.like_count, 0) AS like_count,
                  COALESCE(c.quality_score, 0) AS doc_quality, e.ts
           FROM ev e LEFT JOIN corpus c ON c.doc_id = e.doc_id""",
        "ev", "corpus",
    ),
)
def a7(spark, d):
    log = behaviour.build_event_log(b.events(spark, d), b.corpus(spark, d))
    return log.select(
        "event_id", "uid", "doc_id", "event_type", "query", "result_pos", "duration_ms", "bm25_score", "fine_score",
        "click_count", "like_count", "doc_quality", "ts",
    )


# ---------------------------------------------------------------- B


def utterances(spark, d):
    return b.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw"))


def _norm_sql(x: str) -> str:
    low = text.ascii_lowercase
    out = f"translate({x}, '{text.WIDE_FROM}', '{text.WIDE_TO}')"
    out = rf"regexp_replace({out}, '([A-Za-z])([0-9])', '\1 \2', 'g')"
    out = rf"regexp_replace({out}, '([0-9])([A-Za-z])', '\1 \2', 'g')"
    out = f"translate({out}, '{text.ascii_uppercase}', '{low}')"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')"
    out = rf"regexp_replace({out}, '[^a-z0-9 ''\-_\x{{80}}-\x{{10FFFF}}]', '', 'g')"
    for c in low:
        out = f"regexp_replace({out}, '{c}{{3,}}', '{c}{c}', 'g')"
    stop = ", ".join("'" + w + "'" for w in text.STOP_WORDS)
    return f"array_to_string(list_filter(string_split({out}, ' '), lambda w: w <> '' AND NOT list_contains([{stop}], w)), ' ')"


@query("b1_normalize", f"SELECT conv_id, turn, {_norm_sql('text')} AS normalized FROM conversations")
def b1(spark, d):
    return textprep.normalize_queries(utterances(spark, d)).select("conv_id", "turn", "normalized")


@query(
    "b2_validate",
    r"""SELECT conv_id, turn,
               CASE WHEN text = '' THEN 'empty' WHEN strlen(text) > 200 THEN 'too long'
                    WHEN regexp_matches(text, '[\x00\r\n]') THEN 'invalid characters' ELSE 'ok' END AS outcome,
               CASE WHEN NOT (text = '' OR strlen(text) > 200 OR regexp_matches(text, '[\x00\r\n]'))
                    THEN regexp_matches(text, '[A-Z]|[^\x00-\x7F]') END AS needs_normalization
        FROM conversations""",
)
def b2(spark, d):
    ok, bad = textprep.validate_queries(utterances(spark, d))
    good = ok.select("conv_id", "turn", F.lit("ok").alias("outcome"), "needs_normalization")
    return good.unionByName(
        bad.select("conv_id", "turn", F.col("reason").alias("outcome"), F.lit(None).cast("boolean").alias("needs_normalization"))
    )


@query(
    "b3_tokenize_queries",
    f"SELECT conv_id, turn, len({tok('text')})::INT AS n_terms, array_to_string({tok('text')}, ' ') AS terms FROM conversations",
)
def b3(spark, d):
    out = textprep.tokenize_queries(utterances(spark, d), "raw")
    return out.select("conv_id", "turn", F.size("terms").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


@query("b4_tokenize_corpus", sql("SELECT doc_id, field, field_ord, term FROM fterms", "fterms"))
def b4(spark, d):
    return index.tokenize_corpus(b.corpus(spark, d))


def dictionaries(spark, d):
    """Term pairs from neighbouring words of all documents, in turn synonyms, related, abbreviations and
    category terms, each list in alphabetical order."""
    t = b.table(spark, d, "documents").select(text.tokens("text").alias("t")).filter(F.size("t") >= 2)
    places = F.sequence(F.lit(0), F.size("t") - 2)
    pairs = t.select(
        F.explode(
            F.transform(
                places, lambda i: F.struct((i % 4 + 1).alias("stage"), F.get("t", i).alias("term"), F.get("t", i + 1).alias("expansion"))
            )
        ).alias("p")
    ).select("p.*").filter(F.col("term") != F.col("expansion")).distinct()
    order = Window.partitionBy("stage", "term").orderBy("expansion")
    rows = pairs.withColumn("ord", F.row_number().over(order)).select("stage", "term", "ord", "expansion")
    abbr = textprep.both_directions(rows.filter("stage = 3"))
    return rows.filter("stage <> 3").unionByName(abbr)


_EXPAND_HEAD = f"""
heads AS (SELECT {tok('text')} AS t FROM documents),
places AS (SELECT t, unnest(range(0, len(t) - 1)) AS i FROM heads WHERE len(t) >= 2),
raw_pairs AS (
  SELECT DISTINCT * FROM (
    SELECT (i % 4 + 1)::INT AS stage, t[i + 1] AS term, t[i + 2] AS expansion FROM places) WHERE term <> expansion),
dict AS (
  SELECT stage, term, expansion, MIN(ord) AS ord FROM (
    SELECT stage, term, expansion, row_number() OVER (PARTITION BY stage, term ORDER BY expansion) AS ord FROM raw_pairs
    UNION ALL
    SELECT 3, expansion, term, 1000000 + row_number() OVER (PARTITION BY expansion ORDER BY term) FROM raw_pairs WHERE stage = 3)
  GROUP BY stage, term, expansion),
s0 AS (SELECT query_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM q),
"""


def _stage(i: int) -> str:
    prev = f"s{i - 1}"
    return f"""
add{i} AS (
  SELECT query_id, expansion AS term, row_number() OVER (PARTITION BY query_id ORDER BY pos, ord, expansion) AS k FROM (
    SELECT p.query_id, d.expansion, p.pos, d.ord,
           row_number() OVER (PARTITION BY p.query_id, d.expansion ORDER BY p.pos, d.ord) AS first
    FROM {prev} p JOIN dict d ON d.stage = {i} AND d.term = p.term
    WHERE NOT EXISTS (SELECT 1 FROM {prev} x WHERE x.query_id = p.query_id AND x.term = d.expansion)) WHERE first = 1),
s{i} AS (
  SELECT * FROM {prev} UNION ALL
  SELECT a.query_id, a.term, m.top + a.k FROM add{i} a JOIN (SELECT query_id, MAX(pos) AS top FROM {prev} GROUP BY 1) m ON m.query_id = a.query_id),
"""


_EXPAND = (
    "WITH "
    + _EXPAND_HEAD
    + "".join(_stage(i) for i in (1, 2, 3, 4))
    + """
ranked AS (SELECT query_id, term, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM s4)
SELECT r.query_id, array_to_string(list(r.term ORDER BY r.pos), ' ') AS terms
FROM ranked r JOIN q ON q.query_id = r.query_id WHERE r.rn <= greatest(5, 2 * len(q.terms)) GROUP BY r.query_id"""
)


@query("b5_expand", sql(_EXPAND, "q"))
def b5(spark, d):
    out = textprep.expand_queries(b.queries(spark, d), dictionaries(spark, d))
    return out.select("query_id", F.array_join("terms", " ").alias("terms"))


@query(
    "b6_infer_category",
    sql(
        f"""WITH kw AS (SELECT term, arg_min(lang, doc_id) AS category FROM (
              SELECT doc_id, lang, unnest({tok('text')}) AS term FROM documents) WHERE term IS NOT NULL GROUP BY term),
            hits AS (SELECT query_id, pos, kw.category FROM (
              SELECT query_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM q) t JOIN kw ON kw.term = t.term)
            SELECT q.query_id, COALESCE(h.category, 'general') AS category
            FROM q LEFT JOIN (SELECT query_id, arg_min(category, pos) AS category FROM hits GROUP BY 1) h ON h.query_id = q.query_id""",
        "q",
    ),
)
def b6(spark, d):
    return textprep.infer_category(b.queries(spark, d), keyword_map(spark, d)).select("query_id", "category")


def keyword_map(spark, d):
    """Every token of every document → language of the first document that has it."""
    seen = b.table(spark, d, "documents").select("doc_id", "lang", F.explode(text.tokens("text")).alias("term"))
    return seen.groupBy("term").agg(F.min_by("lang", "doc_id").alias("category"))


def embed_sql(x: str, dim: int) -> str:
    seeds = ", ".join(f"{s}::BIGINT" for s in vectors.dim_seeds(dim))
    return f"""list_transform([{seeds}], lambda s: list_sum(list_transform({x},
                 lambda t: ((xor(('0x' || left(md5(t), 8))::BIGINT, s) & {vectors.LOW_BITS}) / {vectors.HALF_RANGE}::DOUBLE - 1)::DOUBLE)))"""


_EMBED = f"""WITH raw AS (SELECT item_id, {embed_sql(tok('text'), 16)} AS v FROM benchmark),
   unit AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw)
   SELECT item_id, i - 1 AS pos, round(v[i] / n, 6) AS value FROM (SELECT *, unnest(range(1, 17)) AS i FROM unit)"""


def unfold(df: DataFrame, key: str, emb: str = "embedding") -> DataFrame:
    """One row per entry at six decimals; as in SQL, what rounds to zero keeps its sign."""
    return df.select(key, F.posexplode(emb).alias("pos", "v")).select(
        key, F.col("pos").cast("long").alias("pos"), (F.signum("v") * F.round(F.abs("v"), 6)).alias("value")
    )


def with_words(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text has a word; others have no direction and, as in SQL, no vector."""
    return df.filter(F.size(text.tokens(col)) > 0)


@query("b7_hash_embed", _EMBED)
def b7(spark, d):
    return unfold(vectors.hash_embed(b.table(spark, d, "benchmark"), "text", 16), "item_id")


@query(
    "b8_encode_corpus",
    f"""WITH raw AS (SELECT doc_id, {embed_sql(tok('text'), 8)} AS v FROM documents),
        unit AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw WHERE v[1] IS NOT NULL)
        SELECT doc_id, i - 1 AS pos, round(v[i] / n, 6) AS value FROM (SELECT *, unnest(range(1, 9)) AS i FROM unit)""",
)
def b8(spark, d):
    return unfold(vectors.encode_corpus(with_words(b.table(spark, d, "documents"), "text"), "text", 8), "doc_id")


@query(
    "b9_mean_pool",
    sql(
        """WITH m AS (SELECT label, i, AVG(embedding[i]) AS v FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM vec) GROUP BY 1, 2),
                n AS (SELECT label, sqrt(SUM(v * v)) AS n FROM m GROUP BY 1)
           SELECT m.label, i - 1 AS pos, round(v / n.n, 6) AS value FROM m JOIN n ON n.label = m.label""",
        "vec",
    ),
)
def b9(spark, d):
    return unfold(vectors.mean_pool(b.vectors(spark, d), "label"), "label")


# ---------------------------------------------------------------- C


@query("c1_postings", sql("SELECT term, doc_id, tf, field_weight, doc_len FROM postings", "postings"))
def c1(spark, d):
    return index.build_postings(b.corpus(spark, d))


@query(
    "c2_corpus_stats",
    sql("SELECT n_docs, total_len, round(avg_len, 6) AS avg_len, (SELECT COUNT(*) FROM tstats) AS n_terms FROM stats", "tstats"),
)
def c2(spark, d):
    return index.index_health(b.snapshot(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query("c3_term_stats", sql("SELECT term, df, round(idf, 6) AS idf FROM tstats", "tstats"))
def c3(spark, d):
    corpus = b.corpus(spark, d)
    return index.term_stats(index.build_postings(corpus), index.corpus_stats(corpus)).withColumn("idf", F.round("idf", 6))


@query(
    "c4_search_or",
    sql(
        """SELECT * FROM (SELECT query_id, doc_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id)::INT AS rank
             FROM (SELECT query_id, doc_id, COUNT(*) AS matched FROM hits GROUP BY 1, 2)) WHERE rank <= 1000""",
        "hits",
    ),
)
def c4(spark, d):
    return index.search_or(b.queries(spark, d), b.snapshot(spark, d))


@query(
    "c5_search_and",
    sql(
        """SELECT h.query_id, h.doc_id FROM hits h JOIN q ON q.query_id = h.query_id GROUP BY h.query_id, h.doc_id, q.terms
           HAVING COUNT(*) = len(list_distinct(q.terms))""",
        "hits",
    ),
)
def c5(spark, d):
    return index.search_and(b.queries(spark, d), b.snapshot(spark, d))


@query(
    "c6_doc_postings",
    sql("SELECT doc_id, term, tf, field_weight, doc_len FROM postings WHERE doc_id IN (SELECT item_id FROM benchmark)", "postings"),
)
def c6(spark, d):
    ids = b.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    maps = index.doc_postings(b.snapshot(spark, d).postings, ids)
    return maps.select("doc_id", F.explode("entries").alias("term", "p")).select("doc_id", "term", "p.tf", "p.field_weight", "p.doc_len")


@query(
    "c7_update_postings",
    sql(
        "SELECT term, doc_id, tf, field_weight, doc_len FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "postings",
    ),
)
def c7(spark, d):
    """Start from an index whose labelled documents hold other text, restore them, delete toxic ones."""
    corpus = b.corpus(spark, d)
    labels = b.table(spark, d, "labels")
    changed = corpus.join(labels.select("doc_id"), "doc_id", "left_semi")
    stale = corpus.withColumn("content", F.concat(F.lit("stale words "), "author")).join(labels.select("doc_id"), "doc_id", "left_semi")
    old = index.build_postings(corpus.join(labels.select("doc_id"), "doc_id", "left_anti").unionByName(stale))
    return index.update_postings(old, changed, labels.filter("toxic = 1").select("doc_id"))


@query(
    "c8_rebuild_index",
    sql("SELECT term, df, round(idf, 6) AS idf FROM tstats", "tstats"),
)
def c8(spark, d):
    path = scratch(spark, "rebuild")
    corpus = b.corpus(spark, d)
    snapshots.rebuild_index(corpus, path, b.ANCHOR - 400 * b.DAY)
    snapshots.rebuild_index(corpus, path, b.AS_OF)
    return snapshots.read_index(spark, path).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def changed_corpus(spark, d) -> DataFrame:
    """The corpus after toxic documents were deleted and the other labelled ones of low quality edited."""
    labels = b.table(spark, d, "labels")
    kept = b.corpus(spark, d).join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    poor = labels.filter("quality = 0").groupBy("doc_id").agg(F.lit(True).alias("_poor"))
    edited = F.concat(F.lit("revised "), "content")
    return kept.join(poor, "doc_id", "left").withColumn("content", F.when(F.col("_poor"), edited).otherwise(F.col("content"))).drop("_poor")


@query(
    "c8_changed_documents",
    """SELECT doc_id, CASE WHEN MAX(toxic) = 1 THEN 'delete' ELSE 'edit' END AS change FROM labels
       WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id HAVING MAX(toxic) = 1 OR MIN(quality) = 0""",
)
def c8_changes(spark, d):
    path = scratch(spark, "changes")
    corpus = b.corpus(spark, d)
    snapshots.write_index(index.build_index(corpus), path, b.AS_OF, corpus)
    return snapshots.changed_documents(changed_corpus(spark, d), path)


@query(
    "c8_rebuild_versions",
    sql(
        """WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
           SELECT 1::BIGINT AS version, 'documents' AS kind, (SELECT n_docs FROM stats)::BIGINT AS n
           UNION ALL SELECT 1, 'vectors', COUNT(*) FROM documents
           UNION ALL SELECT 1, 'revised', (SELECT COALESCE(MAX(df), 0) FROM tstats WHERE term = 'revised')
           UNION ALL SELECT 2, 'documents', COUNT(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
           UNION ALL SELECT 2, 'vectors', COUNT(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
           UNION ALL SELECT 2, 'revised', COUNT(DISTINCT p.doc_id) FROM (
             SELECT doc_id FROM postings WHERE term = 'revised' UNION ALL SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)) p
             WHERE p.doc_id NOT IN (SELECT doc_id FROM gone)""",
        "tstats",
    ),
)
def c8_versions(spark, d):
    """Edits and deletes alone set off a rebuild, vectors included; a third call finds nothing to do; version 1 can still be read."""
    path = scratch(spark, "versions")
    before, after = b.corpus(spark, d), changed_corpus(spark, d)

    def rebuild(corpus):
        encoded = vectors.encode_corpus(corpus, "title", 16)
        return snapshots.rebuild_index(corpus, path, b.AS_OF, None, 1, encoded, 16)

    made = [rebuild(before), rebuild(after), rebuild(after)]
    out = None
    for version in filter(None, made):
        ix = snapshots.read_index(spark, path, version)
        rows = ix.stats.select(F.lit("documents").alias("kind"), F.col("n_docs").alias("n"))
        count = snapshots.read_vectors(spark, path, 16, version).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(count.select(F.lit("vectors").alias("kind"), "n"))
        df = ix.terms.filter("term = 'revised'").agg(F.coalesce(F.max("df"), F.lit(0).cast("bigint")).alias("n"))
        rows = rows.unionByName(df.select(F.lit("revised").alias("kind"), "n"))
        rows = rows.withColumn("version", F.lit(version).cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("version", "kind", "n")
