"""Queries of retrieval over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import session
from lodestrata.catalog import table
from lodestrata.functions.text import first_words, tag_name
from lodestrata.operators import evaluation as E
from lodestrata.operators import knn
from lodestrata.operators import retrieval as R
from lodestrata.plans import text

QUERIES, ORACLES = {}, {}
AS_OF = 1767225600
#: A fixed set of searches in the words of the test documents.
ASKED = ["scoped relay process", "sharded session receipt", "read-only tag facet", "orphaned field guide", "redacted rerank model", "remote duplicate sweep", "throttled precision gate memory budget", "when does the legacy timer wheel drain", "notes on the keyword side", "nosuchword zzzz"]


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.searchable(table(spark, sf_dir, "docs"))


_indexes: dict[tuple, R.Index] = {}


def _index(spark: SparkSession, sf_dir: str, name: str) -> R.Index:
    """The index of docs or chunks, built once an application for the files of the table as they are now."""
    rows = table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, session.generation, name, *session.file_states(rows))
    if key not in _indexes:
        _indexes[key] = R.indexed(_docs(spark, sf_dir) if name == "docs" else rows.select("id", F.col("content").alias("text")))
    return _indexes[key]


def _asked(spark: SparkSession) -> DataFrame:
    return R.query_frame(spark, ASKED)


_TIME = "CASE WHEN mtime >= 1420070400 AND mtime < 1767225600 THEN mtime WHEN mtime / 1e3 >= 1420070400 AND mtime / 1e3 < 1767225600 THEN mtime / 1e3 WHEN mtime / 1e6 >= 1420070400 AND mtime / 1e6 < 1767225600 THEN mtime / 1e6 END"
_ALL = f"""WITH asked(qid, query) AS (VALUES {", ".join(f"({k}, '{q}')" for k, q in enumerate(ASKED, 1))}),
everything AS (SELECT id, title, concat_ws(' ', title, content) AS text, content, source_id, coalesce(kind, 'doc') AS kind, coalesce(lifecycle, 'active') AS lifecycle,
  coalesce(nullif(lower(trim(coalesce(status, ''))), ''), 'canonical') AS status, {_TIME} AS "at", coalesce(importance, 0) AS importance, coalesce(tokens_est, 0) AS tokens_est, path, ext_id FROM docs),
d AS (SELECT * FROM everything WHERE lifecycle NOT IN ('pending_delete', 'archived') AND status <> 'duplicate'),
"""
_STATUS = "CASE status WHEN 'plan' THEN 0.85 WHEN 'stale' THEN 0.5 WHEN 'duplicate' THEN 0.6 WHEN 'superseded' THEN 0.3 ELSE 1 END"
_FRESH = f"""coalesce(0.5 + 0.5 / (1 + greatest(0, ({AS_OF} - "at") / 86400) / 90), 0.5)"""


def _bm25_sql(of: str, pool: int) -> str:
    return f"""w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}') AS w FROM {of}),
size AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM w),
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')[1:24]) AS term FROM asked),
hits AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT qid, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM hits JOIN df USING (term) JOIN qt USING (term) CROSS JOIN size GROUP BY qid, id),
lexical AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM bm QUALIFY rank < {pool}),
"""


def _dense_sql(of: str, pool: int) -> str:
    def vectors(name: str, frm: str, key: str, text: str) -> str:
        dim = "CAST(('0x' || md5(term)[7:8] || md5(term)[5:6] || md5(term)[3:4] || md5(term)[1:2]) AS BIGINT) % 384"
        return f"""{name}_n AS (SELECT id, {dim} AS dim, count(*) AS n FROM (SELECT {key} AS id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{2,}}')) AS term FROM {frm}) GROUP BY ALL),
{name} AS (SELECT id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_n),
"""

    return (
        vectors("dv", of, "id", "text")
        + vectors("qv", "asked", "qid", "query")
        + f"""dn AS (SELECT q.id AS qid, v.id, round((1 + round(sum(v.weight * q.weight), 6)) / 2, 7) AS score FROM dv v JOIN qv q USING (dim) GROUP BY ALL),
near AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM dn QUALIFY rank < {pool}),
"""
    )


_FUSED = "fused AS (SELECT qid, id, sum(1 / (60 + rank)) AS rrf FROM (SELECT qid, id, rank FROM lexical UNION ALL SELECT qid, id, rank FROM near) GROUP BY ALL),\n"


@_query("bm25_topk", _ALL + _bm25_sql("d", 10) + "x AS (SELECT 1) SELECT qid, id, score, rank FROM lexical")
def _(spark, sf_dir):
    return R.bm25(R.visible(_docs(spark, sf_dir)), _asked(spark), 10, _index(spark, sf_dir, "docs"))


@_query("hashed_knn_topk", _ALL + _dense_sql("d", 10) + "x AS (SELECT 1) SELECT qid, id, score, rank FROM near")
def _(spark, sf_dir):
    return R.dense(R.visible(_docs(spark, sf_dir)), _asked(spark), 10, _index(spark, sf_dir, "docs"))


@_query("hashed_embed", _ALL + _dense_sql("everything", 10) + "x AS (SELECT 1) SELECT id, dim, round(weight, 6) AS weight FROM dv")
def _(spark, sf_dir):
    return R.hashed_terms(_docs(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@_query("rrf_fusion", _ALL + _bm25_sql("d", 25) + _dense_sql("d", 25) + _FUSED + "x AS (SELECT 1) SELECT qid, id, round(rrf, 9) AS rrf FROM fused")
def _(spark, sf_dir):
    d, q, ix = R.visible(_docs(spark, sf_dir)), _asked(spark), _index(spark, sf_dir, "docs")
    return R.fuse(R.bm25(d, q, 25, ix), R.dense(d, q, 25, ix)).withColumn("rrf", F.round("rrf", 9))


@_query(
    "flagship_hybrid_topk",
    _ALL + _bm25_sql("d", 25) + _dense_sql("d", 25) + _FUSED + f"""scored AS (SELECT qid, f.id, round(rrf * ({_FRESH} * {_STATUS} * (1 + 0.35 * importance)), 9) AS score FROM fused f JOIN d ON d.id = f.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 5""",
)
def _(spark, sf_dir):
    return R.hybrid(R.visible(_docs(spark, sf_dir)), _asked(spark), AS_OF, 5, index=_index(spark, sf_dir, "docs"))


@_query(
    "dense_boot_floor",
    _ALL + "r AS (SELECT * FROM d WHERE kind = 'record'),\n" + _dense_sql("r", 25) + f"""scored AS (SELECT qid, n.id, round(score * {_FRESH} * {_STATUS}, 6) AS score FROM near n JOIN r ON r.id = n.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored WHERE score >= 0.3 QUALIFY rank < 5""",
)
def _(spark, sf_dir):
    """Records above a floor on the absolute scale, as an agent gets them at its start."""
    return R.dense_above(R.visible(_docs(spark, sf_dir), kinds=["record"]), _asked(spark), AS_OF, 0.3, 5, _index(spark, sf_dir, "docs"))


@_query(
    "hybrid_of_kind",
    _ALL + "r AS (SELECT * FROM d WHERE kind = 'note'),\n" + _bm25_sql("r", 50) + _dense_sql("r", 50) + _FUSED + f"""scored AS (SELECT qid, f.id, round(rrf * ({_FRESH} * {_STATUS} * (1 + 0.35 * importance)), 9) AS score FROM fused f JOIN d ON d.id = f.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 5""",
)
def _(spark, sf_dir):
    """The flagship search among notes: filtered, so from the larger pool."""
    return R.hybrid(R.visible(_docs(spark, sf_dir), kinds=["note"]), _asked(spark), AS_OF, 5, True, _index(spark, sf_dir, "docs"))


@_query(
    "boot_pointers",
    _ALL + "own AS (SELECT *, 'owner/' || split_part(lower(regexp_replace(trim(tag), '^/+|/+$', '', 'g')), '/', 2) AS owner FROM doc_tags WHERE lower(regexp_replace(trim(tag), '^/+|/+$', '', 'g')) = 'owner/dar'),\nr AS (SELECT * FROM d WHERE id IN (SELECT doc_id FROM own)),\n" + _dense_sql("r", 25) + f"""scored AS (SELECT qid, n.id, round(score * {_FRESH} * {_STATUS}, 6) AS score FROM near n JOIN r ON r.id = n.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored WHERE score >= 0.25 QUALIFY rank < 5""",
)
def _(spark, sf_dir):
    """What an agent is pointed to at its start: documents tagged as its own, however the agent is spelled, above a floor on the absolute scale."""
    return R.boot_pointers(R.visible(_docs(spark, sf_dir)), table(spark, sf_dir, "doc_tags"), "Dar", _asked(spark), AS_OF, 0.25, 5, _index(spark, sf_dir, "docs"))


@_query(
    "tag_filtered_topk",
    _ALL + "t AS (SELECT * FROM d WHERE id IN (SELECT doc_id FROM doc_tags WHERE starts_with(lower(regexp_replace(trim(tag), '^/+|/+$', '', 'g')), 'area'))),\n" + _bm25_sql("t", 10) + "x AS (SELECT 1) SELECT qid, id, score, rank FROM lexical",
)
def _(spark, sf_dir):
    """Search among the documents of any tag in an area; the tags are a semi-join before the limit."""
    tagged = table(spark, sf_dir, "doc_tags").where(F.startswith(tag_name(F.col("tag")), F.lit("area")))
    return R.bm25(R.visible(_docs(spark, sf_dir), tagged=tagged), _asked(spark), 10, _index(spark, sf_dir, "docs"))


@_query("source_scoped_topk", _ALL + "t AS (SELECT * FROM d WHERE source_id = 'code-quill'),\n" + _bm25_sql("t", 10) + "x AS (SELECT 1) SELECT qid, id, score, rank FROM lexical")
def _(spark, sf_dir):
    # The sources are few, one row each.
    known = [r[0] for r in table(spark, sf_dir, "docs").select("source_id").distinct().collect()]
    scope = R.resolve_scope(known, asked="code-quill") if "code-quill" in known else None
    return R.bm25(R.visible(_docs(spark, sf_dir), sources=scope), _asked(spark), 10, _index(spark, sf_dir, "docs"))


# Chunks: candidates of both kinds over all chunks of visible documents.
_CHUNKS = _ALL + "c AS (SELECT c.id, c.doc_id, c.heading_path, c.content AS text FROM chunks c WHERE c.doc_id IN (SELECT id FROM d)),\n" + _bm25_sql("c", 50) + _dense_sql("c", 50) + _FUSED
_CHUNKS += "hit AS (SELECT qid, f.id, c.doc_id, round(rrf, 9) AS score FROM fused f JOIN c ON c.id = f.id),\n"


def _chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_chunks(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir), _asked(spark), _index(spark, sf_dir, "chunks"), 8)


_TAGGED = "SELECT doc_id FROM doc_tags WHERE starts_with(lower(regexp_replace(trim(tag), '^/+|/+$', '', 'g')), 'area')"
_SCOPED = _ALL + f"c AS (SELECT c.id, c.doc_id, c.content AS text FROM chunks c WHERE c.doc_id IN (SELECT id FROM everything WHERE lifecycle <> 'pending_delete' AND status <> 'duplicate' AND kind = 'note' AND source_id = 'code-quill' AND id IN ({_TAGGED}))),\n" + _bm25_sql("c", 4096) + _dense_sql("c", 4096) + _FUSED


@_query("chunk_search_scoped", _SCOPED + "hit AS (SELECT qid, f.id, c.doc_id, round(rrf, 9) AS score FROM fused f JOIN c ON c.id = f.id) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM hit QUALIFY rank < 5")
def _(spark, sf_dir):
    """Chunks of notes of one source with any tag of an area, archived ones too."""
    tagged = table(spark, sf_dir, "doc_tags").where(F.startswith(tag_name(F.col("tag")), F.lit("area")))
    hits = R.search_chunks(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir), _asked(spark), _index(spark, sf_dir, "chunks"), 5, "note", "code-quill", tagged, archived=True)
    return knn.best(hits, "qid", "id", 5, "score")


@_query("chunk_search", _CHUNKS + "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM hit) SELECT * FROM r WHERE rank < 8")
def _(spark, sf_dir):
    return knn.best(_chunk_hits(spark, sf_dir), "qid", "id", 8, "score")


@_query(
    "best_chunk_per_doc",
    _CHUNKS + """one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, id) = 1)
SELECT qid, doc_id, id, score, round(score / max(score) OVER (PARTITION BY qid), 6) AS share, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM one QUALIFY rank < 12""",
)
def _(spark, sf_dir):
    return R.best_per_document(_chunk_hits(spark, sf_dir))


@_query("facet_counts", _CHUNKS + """f AS (SELECT qid, tag, count(*) AS n FROM (SELECT DISTINCT qid, doc_id FROM hit) JOIN (SELECT DISTINCT doc_id, tag FROM doc_tags) USING (doc_id) WHERE tag <> 'quo' GROUP BY ALL)
SELECT qid, tag, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tag) - 1 AS rank FROM f QUALIFY rank < 12""")
def _(spark, sf_dir):
    return R.facet_counts(_chunk_hits(spark, sf_dir), table(spark, sf_dir, "doc_tags"), ["quo"])


_ACCESS = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(c.text, chr(13) || chr(10), chr(10)), '(?s)```.*?```', '', 'g'), '(?m)^#+\s+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' '), lambda x: x <> '')"


@_query(
    "access_ladder",
    _CHUNKS + f"""top AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1),
passages AS (SELECT doc_id, heading_path, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS passage FROM chunks GROUP BY ALL)
SELECT t.qid, t.id, array_to_string(({_ACCESS})[1:50], ' ') || CASE WHEN len({_ACCESS}) > 50 THEN '…' ELSE '' END AS card, p.passage, d.content AS whole
FROM top t JOIN c ON c.id = t.id JOIN d ON d.id = t.doc_id LEFT JOIN passages p ON p.doc_id = c.doc_id AND p.heading_path IS NOT DISTINCT FROM c.heading_path""",
)
def _(spark, sf_dir):
    """The best chunk of each query at three widths: a card, its whole section, its document."""
    top = knn.best(_chunk_hits(spark, sf_dir), "qid", "id", 1, "score").select("qid", "id", "doc_id")
    chunks = table(spark, sf_dir, "chunks")
    hit = top.join(chunks.select("id", "heading_path", F.col("content").alias("text")), "id")
    # Only the sections of the hits are put together.
    same = chunks.select(F.col("doc_id").alias("d"), F.col("heading_path").alias("h"), "chunk_index", F.col("id").alias("c"), "content")
    parts = hit.join(same, (F.col("doc_id") == F.col("d")) & F.col("heading_path").eqNullSafe(F.col("h"))).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "c", "content"))).alias("p"))
    whole = table(spark, sf_dir, "docs").select(F.col("id").alias("doc_id"), F.col("content").alias("whole"))
    return hit.join(parts, "qid").join(whole, "doc_id").select("qid", "id", first_words(F.col("text"), 50).alias("card"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("passage"), "whole")


@_query(
    "rerank_order_repair",
    """WITH c AS (SELECT DISTINCT query_id AS qid, rank AS idx FROM mcp_query_results),
    a AS (SELECT qid, [(qid * 7) % 5, 99, (qid * 3) % 5, (qid * 7) % 5] AS o FROM (SELECT DISTINCT qid FROM c)),
    s AS (SELECT qid, idx, min(pos) AS pos FROM (SELECT qid, unnest(o) AS idx, generate_subscripts(o, 1) AS pos FROM a) GROUP BY ALL)
    SELECT c.qid, c.idx, row_number() OVER (PARTITION BY c.qid ORDER BY pos ASC NULLS LAST, c.idx) - 1 AS place FROM c LEFT JOIN s ON s.qid = c.qid AND s.idx = c.idx""",
)
def _(spark, sf_dir):
    """Orders with unknown, repeated and missing indexes, repaired."""
    c = table(spark, sf_dir, "mcp_query_results").select(F.col("query_id").alias("qid"), F.col("rank").alias("idx")).distinct()
    i = F.col("qid")
    a = c.select("qid").distinct().select("qid", F.to_json(F.array(i * 7 % 5, F.lit(99).cast("long"), i * 3 % 5, i * 7 % 5)).alias("answer"))
    return R.repaired_order(a, c)


@_query(
    "rerank_local",
    _ALL + _bm25_sql("d", 20) + """r AS (SELECT l.qid, l.id, l.rank, count(*) OVER (PARTITION BY l.qid) AS n, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{2,}')) AS q, regexp_extract_all(lower(coalesce(title, '') || '. ' || coalesce(content, '')[1:400]), '[a-z0-9]{2,}') AS w FROM lexical l JOIN d USING (id) JOIN asked a ON a.qid = l.qid),
    s AS (SELECT *, round(len(list_intersect(q, w)) / len(q), 6) AS relevance FROM r)
    SELECT qid, id, relevance, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 5 THEN -relevance END, rank) - 1 AS place FROM s QUALIFY place < 5""",
)
def _(spark, sf_dir):
    """Twenty candidates re-scored by the built-in scorer on title and the start of the text."""
    d, q = R.visible(_docs(spark, sf_dir)), _asked(spark)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("content", F.lit("")), 1, 400))
    hits = R.bm25(d, q, 20, _index(spark, sf_dir, "docs")).join(d.select("id", text.alias("text")), "id").join(q, "qid")
    return R.rerank(hits, "query", "text", 5)


@_query("rerank_texts", _ALL + _bm25_sql("d", 5) + "f AS (SELECT doc_id, arg_min(content, (chunk_index, id)) AS content FROM chunks WHERE chunk_index = 0 GROUP BY doc_id) SELECT qid, l.id, coalesce(title, '') || '. ' || coalesce(f.content, '')[1:400] AS text FROM lexical l JOIN d USING (id) LEFT JOIN f ON f.doc_id = l.id")
def _(spark, sf_dir):
    """What a reranker reads of each candidate: its title and the start of its first chunk."""
    d = R.visible(_docs(spark, sf_dir))
    first = table(spark, sf_dir, "chunks").where("chunk_index = 0").groupBy(F.col("doc_id").alias("id")).agg(F.min_by("content", F.struct("chunk_index", "id")).alias("content"))
    hits = R.bm25(d, _asked(spark), 5, _index(spark, sf_dir, "docs")).join(d.select("id", "title"), "id").join(first, "id", "left")
    return hits.select("qid", "id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("content", F.lit("")), 1, 400)).alias("text"))


@_query("savings_estimate", """SELECT query_id, CAST(greatest(0, sum(t) FILTER (WHERE rank < 3) - coalesce(sum(t) FILTER (WHERE rank = 0), 0) - sum(length(path)) FILTER (WHERE rank < 3) // 4) AS BIGINT) AS saved FROM (SELECT DISTINCT query_id, rank, path, coalesce(tokens_est, 0) AS t FROM mcp_query_results) GROUP BY query_id HAVING count(*) FILTER (WHERE rank < 3) > 0""")
def _(spark, sf_dir):
    """What the first three results would have cost beyond the first and the pointers to them, by query."""
    r = table(spark, sf_dir, "mcp_query_results").select("query_id", "rank", "path", F.coalesce("tokens_est", F.lit(0)).alias("t")).distinct().where("rank < 3")
    sums = r.groupBy("query_id").agg(F.sum("t").alias("all"), F.sum(F.when(F.col("rank") == 0, F.col("t"))).alias("top"), F.sum(F.char_length("path")).alias("chars"))
    return sums.select("query_id", F.greatest(F.lit(0), F.col("all") - F.coalesce("top", F.lit(0)) - F.floor(F.col("chars") / 4)).alias("saved"))


@_query("listing", _ALL + "m AS (SELECT max(length(path)) AS longest FROM everything) SELECT id, rpad(path, CAST(longest AS INT), ' ') || '  ' || CASE status WHEN 'canonical' THEN '★' WHEN 'plan' THEN '◯' WHEN 'stale' THEN '✗' WHEN 'duplicate' THEN '⚠' WHEN 'superseded' THEN '⤺' ELSE '' END AS line FROM everything, m")
def _(spark, sf_dir):
    return R.listing(_docs(spark, sf_dir))


@_query(
    "eval_run",
    _ALL + _bm25_sql("d", 3) + """h AS (SELECT l.qid, rank, coalesce(d.content, '') AS text, d.path AS line FROM lexical l JOIN d USING (id)),
    r AS (SELECT qid, coalesce(max(text) FILTER (WHERE rank = 0), '') AS own, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS base, string_agg(line, chr(10) ORDER BY rank) AS listing FROM h GROUP BY qid),
    c AS (SELECT a.qid, query, CASE WHEN a.qid % 2 = 0 THEN 'even' ELSE 'odd' END AS category, coalesce(own, '') AS own, coalesce(base, '') AS base, coalesce(listing, '') AS listing FROM asked a LEFT JOIN r USING (qid)),
    s AS (SELECT *, right(own, 400) AS said, right(base, 400) AS base_said, split_part(query, ' ', 1) AS word FROM c)
    SELECT qid, category, contains(lower(base_said), word) AS base_ok, length(base) // 4 + length(base_said) // 4 AS base_tokens, contains(lower(said), word) AS ok, length(own) // 4 + length(said) // 4 + length(listing) // 4 AS tokens FROM s""",
)
def _(spark, sf_dir):
    """Searches answered from the first hit and from the first three, by an answer that is the end of what was read, right if it names the search's first word."""
    d, q = R.visible(_docs(spark, sf_dir)), _asked(spark)
    cases = q.select("qid", "query", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("category"))
    answer = lambda query, context: F.right(context, F.lit(400))
    judge = lambda row, said: F.contains(F.lower(said), F.substring_index(row["query"], " ", 1))
    return E.run_cases(cases, R.bm25(d, q, 3, _index(spark, sf_dir, "docs")), d.select("id", F.col("content").alias("text"), F.col("path").alias("line")), answer, judge)


@_query(
    "listing_summaries",
    _ALL + f"""s AS ({text.ORACLES["snippets"].replace("WITH s AS", "WITH s_ AS").replace("FROM s", "FROM s_")}),
    a AS (SELECT *, ({AS_OF} - "at") / 86400 AS days FROM everything)
    SELECT a.id, path || '  ' || CASE status WHEN 'canonical' THEN '★' WHEN 'plan' THEN '◯' WHEN 'stale' THEN '✗' WHEN 'duplicate' THEN '⚠' WHEN 'superseded' THEN '⤺' ELSE '' END || ' ' ||
      CASE WHEN days IS NULL THEN '' WHEN days < 1 THEN 'fresh' WHEN days < 7 THEN 'fresh ' || CAST(floor(days) AS BIGINT) || 'd' WHEN days < 30 THEN CAST(floor(days) AS BIGINT) || 'd' WHEN days < 365 THEN CAST(floor(days / 7) AS BIGINT) || 'w' ELSE CAST(floor(days / 365) AS BIGINT) || 'y' END
      || '  ~' || tokens_est || 'tok' || coalesce(chr(10) || '  ' || nullif(snippet, ''), '') AS line FROM a LEFT JOIN s ON s.id = a.id""",
)
def _(spark, sf_dir):
    return R.summaries(_docs(spark, sf_dir), AS_OF)


_PROBES = r"""probes AS (SELECT id AS qid, list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 40 AND NOT regexp_matches(x, '^[#*|`-]'))[1][1:200] AS query FROM d WHERE content IS NOT NULL),
asked AS (SELECT qid, query FROM probes WHERE query IS NOT NULL ORDER BY md5(CAST(qid AS VARCHAR)), qid LIMIT 20),
"""


@_query(
    "probe_recall",
    _ALL.replace("asked(qid, query) AS", "unused(qid, query) AS") + _PROBES + _bm25_sql("d", 5) + "r AS (SELECT a.qid, min(rank) AS rank FROM asked a LEFT JOIN lexical l ON l.qid = a.qid AND l.id = a.qid GROUP BY a.qid) SELECT count(*) AS n, round(avg(CASE WHEN rank = 0 THEN 1 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END), 6) AS recall FROM r",
)
def _(spark, sf_dir):
    """Twenty documents drawn by a hash, each searched for by a line of its own: how often it comes first, and among the first five."""
    from lodestrata.functions.text import probe_line

    d = R.visible(_docs(spark, sf_dir))
    drawn = d.select(F.col("id").alias("qid"), probe_line(F.col("content")).alias("query")).where("query is not null").orderBy(F.md5(F.col("qid").cast("string")), "qid").limit(20)
    labels = drawn.select("qid", F.col("qid").alias("id"))
    return E.mean_metrics(E.rank_metrics(R.bm25(d, drawn, 5, _index(spark, sf_dir, "docs")), labels, 5)).select("n", "hit_1", "recall")


# Vectors.
_USABLE = """len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""


def _knn_sql(name: str, where: str, same: str, itself: str) -> str:
    return f"""WITH v AS (SELECT id, source_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {name} WHERE {_USABLE} AND {where}),
n AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON {same} AND {itself} WHERE a.id % 100 = 0)
SELECT id, neighbour, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) - 1 AS rank FROM n QUALIFY rank < 10"""


@_query("knn_topk", _knn_sql("vec_docs", "true", "true", "a.id <> b.id"))
def _(spark, sf_dir):
    v = knn.usable(table(spark, sf_dir, "vec_docs"))
    return knn.nearest(v, v.where("id % 100 = 0"), 10)


@_query("chunk_knn_topk", _knn_sql("vec_chunks", "lifecycle NOT IN ('pending_delete', 'archived') AND status <> 'duplicate'", "true", "a.id <> b.id"))
def _(spark, sf_dir):
    """Filters come before the limit, so they never thin out the neighbours."""
    v = knn.usable(table(spark, sf_dir, "vec_chunks").where("lifecycle not in ('pending_delete', 'archived') and status <> 'duplicate'"))
    return knn.nearest(v, v.where("id % 100 = 0"), 10)


@_query("knn_partitioned", _knn_sql("vec_docs", "true", "a.source_id = b.source_id", "a.id <> b.id"))
def _(spark, sf_dir):
    """Neighbours within the query's own source."""
    v = knn.usable(table(spark, sf_dir, "vec_docs"), "id", "embedding", 64, "source_id")
    return knn.nearest(v, v.where("id % 100 = 0"), 10, within="source_id")
