"""The same bindings as SQL for the oracle. ``sql(body, *names)`` prepends the named views."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

AS_OF = 1706745600


def low(x: str) -> str:
    return f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"


def tok(x: str) -> str:
    return rf"regexp_extract_all({low(x)}, '[^\x00-\x7F]|[a-z0-9]+')"


def words(x: str, n: int) -> str:
    return rf"regexp_extract({x}, '^\s*(\S+(?:\s+\S+){{0,{n - 1}}})', 1)"


def asked(x: str) -> str:
    return rf"unnest(regexp_extract_all({x}, '\S+'))"


def places(x: str) -> str:
    return rf"unnest(range(len(regexp_extract_all({x}, '\S+'))))"


def hot(clicks: str, likes: str) -> str:
    return f"(0.6::DOUBLE * ln(1 + ({clicks})::DOUBLE) + 0.4::DOUBLE * ln(1 + ({likes})::DOUBLE))"


def snip(x: str) -> str:
    head = f"left({x}, 200)"
    fit = f"list_max(list_filter(range(0, 201), lambda n: strlen(left({head}, n)) <= 200))"
    return f"CASE WHEN strlen({head}) <= 200 THEN {head} ELSE left({head}, {fit}) END"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ic": (
        (),
        """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                  SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks,
                  SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS likes
           FROM events GROUP BY 1""",
    ),
    "corpus": (
        ("ic",),
        f"""SELECT d.doc_id, {words('d.text', 8)} AS title, d.text AS content, d.source AS author,
                   d.lang AS category, 1704067200 - (d.doc_id % 365) * 86400 AS publish_time,
                   [d.source, d.lang] AS tags, COALESCE(CAST(l.quality AS DOUBLE), 0.5::DOUBLE) AS quality_score,
                   COALESCE(ic.clicks, 0) AS click_count, COALESCE(ic.likes, 0) AS like_count,
                   strlen(d.text) AS content_length
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN ic ON d.doc_id = ic.k""",
    ),
    "q": (
        (),
        f"""SELECT *, {tok('raw')} AS terms,
                   CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'fr' END AS category
            FROM (SELECT item_id AS query_id, item_id % 100 AS uid, text AS raw FROM benchmark)""",
    ),
    "qlog": (
        (),
        f"""SELECT conv_id AS uid, turn AS ts, {asked('text')} AS query, {places('text')} AS pos, 'turn' || turn AS source
            FROM conversations WHERE role = 'user'""",
    ),
    "ev": (
        (),
        f"""SELECT e.event_id, e.user_id AS uid, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS doc_id,
                   CASE e.event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'like' WHEN 'view' THEN 'view'
                        WHEN 'signup' THEN 'share' WHEN 'error' THEN 'dismiss' END AS event_type,
                   CAST(floor(epoch(e.ts)) AS BIGINT) AS ts, m.text AS query,
                   (e.event_id % 20)::INT AS result_pos,
                   CASE WHEN e.event_type = 'view' THEN floor(e.value * 1000)::INT END AS duration_ms,
                   round(e.value / 1000, 6) AS bm25_score, round((e.value % 100) / 100, 6) AS quality_score,
                   round(exp(-0.05::DOUBLE * (e.event_id % 40)), 6) AS freshness_score,
                   ['inverted_index', 'user_history', 'hot_content', 'vector'][e.event_id % 4 + 1] AS recall_source
            FROM events e LEFT JOIN benchmark m
              ON m.item_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT) % (SELECT COUNT(*) FROM benchmark)""",
    ),
    "vec": (
        (),
        "SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, label FROM embeddings",
    ),
    "cat_counts": (
        (),
        """SELECT l_partkey AS k, COUNT(*) AS clicks,
                  SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS likes FROM lineitem GROUP BY 1""",
    ),
    "catalog": (
        ("cat_counts",),
        """SELECT p_partkey AS doc_id, p_name AS title, p_brand AS author,
                  1704067200 - (p_partkey % 365) * 86400 AS publish_time, p_type AS category,
                  [p_brand, 'size' || p_size] AS tags,
                  COALESCE(c.clicks, 0) AS click_count, COALESCE(c.likes, 0) AS like_count
           FROM part LEFT JOIN cat_counts c ON p_partkey = c.k""",
    ),
    "inter": (
        (),
        """SELECT o_custkey AS uid, l_partkey AS doc_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
                  o_orderkey, l_linenumber
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "fterms": (
        ("corpus",),
        f"""SELECT doc_id, 'title' AS field, 0 AS field_ord, 3.0::DOUBLE AS w, unnest(list_distinct({tok('title')})) AS term FROM corpus
            UNION ALL
            SELECT doc_id, 'content', 0, 1.0::DOUBLE, unnest(list_distinct({tok('content')})) FROM corpus
            UNION ALL
            SELECT doc_id, 'tag', (i - 1)::INT, 2.0::DOUBLE, unnest(list_distinct({tok('tags[i]')}))
            FROM (SELECT doc_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM corpus)
            UNION ALL
            SELECT doc_id, 'category', 0, 1.5::DOUBLE, unnest(list_distinct({tok('category')})) FROM corpus""",
    ),
    "postings": (
        ("fterms",),
        """SELECT f.term, f.doc_id, COUNT(*)::INT AS tf, MAX(f.w) AS field_weight,
                  any_value(CASE WHEN c.content_length > 0 THEN c.content_length ELSE strlen(c.content) END)::BIGINT AS doc_len
           FROM fterms f JOIN corpus c ON f.doc_id = c.doc_id GROUP BY 1, 2""",
    ),
    "stats": (
        ("corpus",),
        """SELECT COUNT(*) AS n_docs, SUM(content_length)::BIGINT AS total_len,
                  AVG(content_length)::DOUBLE AS avg_len FROM corpus""",
    ),
    "tstats": (
        ("postings", "stats"),
        """SELECT term, COUNT(*) AS df,
                  ln((any_value(s.n_docs) - COUNT(*) + 0.5::DOUBLE) / (COUNT(*) + 0.5::DOUBLE)) AS idf
           FROM postings, stats s GROUP BY term""",
    ),
    "qterms": (("q",), "SELECT query_id, unnest(list_distinct(terms)) AS term FROM q"),
    "hits": (
        ("qterms", "postings", "tstats"),
        """SELECT t.query_id, p.*, s.idf FROM qterms t JOIN postings p ON p.term = t.term
           JOIN tstats s ON s.term = t.term""",
    ),
    "text_recall": (
        ("hits",),
        """SELECT query_id, doc_id, matched, recall_score FROM (
             SELECT query_id, doc_id, COUNT(*) AS matched, SUM((1 + ln(1 + tf::DOUBLE)) * idf) AS recall_score,
                    row_number() OVER (PARTITION BY query_id ORDER BY COUNT(*) DESC, doc_id) AS rn
             FROM hits GROUP BY query_id, doc_id) WHERE rn <= 1000""",
    ),
    "bm25": (
        ("hits", "stats"),
        """SELECT query_id, doc_id, tanh(SUM(idf * tf * 2.5::DOUBLE /
                  (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / s.avg_len)) * field_weight) / 10) AS bm25
           FROM hits, stats s GROUP BY query_id, doc_id""",
    ),
    "scored": (
        ("text_recall", "bm25", "corpus"),
        f"""SELECT r.query_id, c.doc_id, r.recall_score, 'inverted_index' AS recall_source, c.title, c.author, c.publish_time,
                   c.category, c.quality_score, c.click_count, c.like_count, {snip('c.content')} AS snippet,
                   COALESCE(b.bm25, 0) AS bm25,
                   0.3::DOUBLE * tanh(ln(1 + c.click_count::DOUBLE) / 5) + 0.4::DOUBLE * tanh(ln(1 + c.like_count::DOUBLE) / 5)
                     + 0.3::DOUBLE * least(greatest(c.quality_score, 0), 1) AS quality,
                   CASE WHEN age >= 0 AND age <= 365 THEN exp(-0.01::DOUBLE * age) ELSE 0 END AS freshness
            FROM text_recall r JOIN (SELECT *, ({AS_OF} - publish_time) / 86400.0::DOUBLE AS age FROM corpus) c ON c.doc_id = r.doc_id
            LEFT JOIN bm25 b ON b.query_id = r.query_id AND b.doc_id = r.doc_id""",
    ),
    "coarse": (
        ("scored",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse_score DESC, doc_id) AS coarse_rank
             FROM (SELECT *, round(0.6::DOUBLE * bm25 + 0.2::DOUBLE * quality + 0.2::DOUBLE * freshness, 6) AS coarse_score FROM scored))
           WHERE coarse_rank <= 500""",
    ),
    "clicks": (("ev",), "SELECT * FROM ev WHERE event_type = 'click'"),
    "click_hist": (
        ("ev",),
        """SELECT uid, event_type AS kind, list(doc_id ORDER BY ts, event_id, doc_id) AS ids FROM (
             SELECT *, row_number() OVER (PARTITION BY uid, event_type ORDER BY ts DESC, event_id DESC, doc_id DESC) AS rn
             FROM ev WHERE event_type IN ('click', 'like')) WHERE rn <= 200 GROUP BY uid, event_type""",
    ),
    "steps": (
        ("ev",),
        """SELECT e.uid, d.lang AS category, SUM(CASE e.event_type WHEN 'click' THEN 0.15::DOUBLE WHEN 'like' THEN 0.4::DOUBLE
                  WHEN 'share' THEN 0.5::DOUBLE WHEN 'view' THEN 0.2::DOUBLE END) AS step
           FROM ev e JOIN documents d ON d.doc_id = e.doc_id
           WHERE e.event_type IN ('click', 'like', 'share') OR (e.event_type = 'view' AND e.duration_ms >= 30000)
           GROUP BY 1, 2""",
    ),
    "weights": (("steps",), "SELECT uid, category, least(1.0::DOUBLE, step) AS weight FROM steps"),
    "active": (
        ("ev",),
        f"""SELECT uid, COUNT(*) AS n_events,
                   SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS total_clicks,
                   SUM(CASE WHEN event_type = 'like' THEN 1 ELSE 0 END)::BIGINT AS total_likes,
                   least(30, COUNT(DISTINCT CASE WHEN ts // 86400 > {AS_OF // 86400 - 30} AND ts // 86400 <= {AS_OF // 86400}
                                    THEN ts // 86400 END))::INT AS active_days
            FROM ev GROUP BY uid""",
    ),
    "cooccur": (
        ("inter",),
        """SELECT src, dst, COUNT(*) AS co_count, MAX(ts) AS last_time FROM (
             SELECT src, dst, ts FROM pairs UNION ALL SELECT dst, src, ts FROM pairs) GROUP BY 1, 2""",
    ),
    "pairs": (
        ("inter",),
        """SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY uid ORDER BY ts, o_orderkey, l_linenumber, doc_id) AS src,
                  doc_id AS dst, ts FROM inter) WHERE src IS NOT NULL AND src <> dst""",
    ),
    "qstats": (
        ("qlog",),
        """SELECT query, COUNT(*) AS freq, MAX(ts) AS last_time,
                  arg_min(source, ts) AS source, MIN(ts) AS first_time
           FROM (SELECT query, ts, source FROM qlog WHERE query <> '') GROUP BY query""",
    ),
}
VIEWS["cooccur"] = (("pairs",), VIEWS["cooccur"][1])


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    views = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {views},\n{body}" if order else f"WITH {body}"
    return f"WITH {views}\n{body}" if order else body
