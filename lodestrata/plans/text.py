"""Queries over the text of documents, titles, tags and queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.catalog import table
from lodestrata.functions import code, markdown
from lodestrata.functions import text as T
from lodestrata.functions.columns import stored_seconds, tokens
from lodestrata.operators import ingest
from lodestrata.session import spread, work_folder
from lodestrata.sources import files

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_UNIX = r"replace(content, chr(13) || chr(10), chr(10))"
_BODY = rf"regexp_replace({_UNIX}, '(?s)\A---\n.*?\n---(\n|\z)', '')"
_FRONT = rf"regexp_extract({_UNIX}, '(?s)\A---\n(.*?)\n---(?:\n|\z)', 1)"


def _front(key: str) -> str:
    return f"nullif(regexp_replace({_strip(f'''regexp_extract({_FRONT}, '(?m)^{key}:[ \\t]*([^\\n]*)', 1)''')}, '^[\"'']+|[\"'']+$', '', 'g'), '')"


@_query("title_slugs", "SELECT id, nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM docs")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").select("id", T.slug(F.col("title")).alias("slug"))


@_query(
    "section_slugs",
    """WITH s AS (SELECT id, doc_id, chunk_index, coalesce(nullif(regexp_replace(regexp_replace(lower(heading_path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM chunks),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY chunk_index, id) AS k FROM s)
    SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS anchor FROM n""",
)
def section_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, sf_dir, "chunks").select("id", "doc_id", "chunk_index", F.coalesce(T.slug(F.col("heading_path")), F.lit("section")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("chunk_index", "id"))
    return s.select("id", F.when(k == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), k.cast("string"))).alias("anchor"))


@_query("literal_filter", "SELECT id, path FROM docs WHERE contains(lower(path), 'plan-') OR contains(lower(path), '_')")
def literal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return table(spark, sf_dir, "docs").where(T.contains_literal(path, F.lit("Plan-")) | T.contains_literal(path, F.lit("_"))).select("id", "path")


@_query(
    "document_titles",
    rf"""SELECT id, coalesce(nullif({_strip(f"regexp_extract({_BODY}[1:2000], '(?m)^#[ \t]+([^\n]+)', 1)")}, ''),
      nullif({_strip(f"regexp_extract({_BODY}[1:2000], '(?m)^#{{1,6}}[ \t]+([^\n]+)', 1)")}, ''), {_front("title")},
      nullif({_strip(rf"regexp_extract({_BODY}, '(?m)^[^\S\n]*(\S[^\n]*)', 1)")}[1:120], ''), 'Untitled') AS title FROM docs WHERE content IS NOT NULL""",
)
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").where("content is not null").select("id", T.document_title(F.col("content")).alias("title"))


@_query(
    "name_titles",
    r"""SELECT id, array_to_string(list_transform(regexp_extract_all(lower(replace(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.mdx?$', ''), '_', ' '), '-', ' ')), '[a-z]+|[^a-z]+'),
      lambda r: upper(r[1:1]) || r[2:]), '') AS title FROM docs""",
)
def name_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").select("id", T.name_title(F.col("path")).alias("title"))


@_query("retitled", f"WITH a AS ({ORACLES['document_titles']}), b AS ({ORACLES['name_titles']}) SELECT d.id, d.title AS stored, coalesce(nullif(a.title, 'Untitled'), b.title) AS title FROM docs d JOIN b ON b.id = d.id LEFT JOIN a ON a.id = d.id WHERE d.title IS NULL OR lower(trim(d.title)) IN ('', 'untitled')")
def retitled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored title says nothing, with a title derived from their text, else from their path."""
    return ingest.retitled(table(spark, sf_dir, "docs"))


@_query("authors", f"SELECT id, coalesce({_front('agent')}, {_front('author')}, {_front('generator')}, {_front('created_by')}) AS author, lower({_front('status')}) AS status FROM docs WHERE {_FRONT} <> ''")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and status of the documents that have front matter."""
    c = F.col("content")
    docs = table(spark, sf_dir, "docs").where(T.front_matter(T.unix_lines(c)) != "")
    return docs.select("id", T.author(c).alias("author"), F.lower(T.front_matter_value(T.unix_lines(c), "status")).alias("status"))


@_query(
    "plan_marks",
    rf"""SELECT id, regexp_matches(path, '(PLAN[_-]|_PLAN\.md$|^plans/|DRAFT|WIP)') AS by_path,
      len(list_filter(list_filter(string_split({_BODY}, chr(10)), lambda x: {_strip("x")} <> '')[1:5], lambda x: regexp_matches(x, '(?i)^#+\s*(plan|todo|draft|wip|brouillon)\b'))) > 0 AS by_heading FROM docs WHERE content IS NOT NULL""",
)
def plan_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").where("content is not null").select("id", T.plan_path(F.col("path")).alias("by_path"), T.looks_like_plan(F.col("content")).alias("by_heading"))


_TOKENS = "CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"


@_query("token_estimate", f"SELECT id, CAST({_TOKENS.format('content')} AS BIGINT) AS tokens, CAST(length(content) // 4 AS BIGINT) AS owned_tokens FROM docs")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").select("id", tokens(F.col("content")).alias("tokens"), F.floor(F.char_length("content") / 4).alias("owned_tokens"))


_REDACTED = "{0}"
for _pattern in T.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[redacted]', 'g')"


@_query("redaction", f"SELECT DISTINCT id, {_REDACTED.replace('{0}', 'query')}[1:500] AS query FROM mcp_queries WHERE query IS NOT NULL")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").where("query is not null").select("id", F.substring(T.redacted(F.col("query")), 1, 500).alias("query")).distinct()


@_query(
    "secret_scan",
    f"""WITH p AS (SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'ask user' || doc_id || '@example.org' WHEN 1 THEN 'AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, '0') WHEN 2 THEN 'api_key: k' || doc_id || chr(10) || 'the key of ' || doc_id ELSE 'nothing here' END AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM p)
    SELECT doc_id, count(*) AS n_lines FROM l WHERE {" OR ".join(f"regexp_matches(line, '{p}')" for p in T.SECRETS)} GROUP BY doc_id""",
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold the shape of a secret; the test documents have none, so each is given a line or two, with one or without."""
    i = F.col("doc_id").cast("string")
    planted = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ask user"), i, F.lit("@example.org"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("AKIA"), F.lpad(i, 16, "0"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("api_key: k"), i, F.lit("\nthe key of "), i)).otherwise(F.lit("nothing here"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), planted).alias("text"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = F.lit(False)
    for pattern in T.SECRETS:
        hit = hit | F.col("line").rlike(pattern)
    return lines.where(hit).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


_SNIP = rf"""{_strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(content[1:20000], chr(13) || chr(10), chr(10)), '(?s)\A---\n.*?\n---\n', ''), '(?s)```.*?```', ' ', 'g'), '(?m)^#+\s*', '', 'g'), '[`*_>]', '', 'g'), '\s+', ' ', 'g')")}"""


@_query("snippets", f"WITH s AS (SELECT id, {_SNIP} AS t FROM docs WHERE content IS NOT NULL) SELECT id, t[1:160] || CASE WHEN length(t) > 160 THEN '…' ELSE '' END AS snippet FROM s")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").where("content is not null").select("id", T.snippet(F.col("content")).alias("snippet"))


@_query(
    "extract_words",
    rf"""WITH w AS (SELECT id, list_filter(string_split({_strip(rf"regexp_replace(regexp_replace(regexp_replace({_UNIX}, '(?s)```.*?```', '', 'g'), '(?m)^#+\s+', '', 'g'), '\s+', ' ', 'g')")}, ' '), lambda x: x <> '') AS w FROM docs WHERE content IS NOT NULL)
    SELECT id, array_to_string(w[1:50], ' ') || CASE WHEN len(w) > 50 THEN '…' ELSE '' END AS card, array_to_string(w[1:28], ' ') || CASE WHEN len(w) > 28 THEN '…' ELSE '' END AS citation FROM w""",
)
def extract_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return table(spark, sf_dir, "docs").where("content is not null").select("id", T.first_words(c, 50).alias("card"), T.first_words(c, 28).alias("citation"))


@_query(
    "highlight",
    r"""SELECT id, regexp_replace(replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(notes|plan|of)', '<mark class="hl">\1</mark>', 'g') AS title FROM docs""",
)
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").select("id", T.highlighted(F.col("title"), ["of", "plan", "notes"]).alias("title"))


@_query("terms", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY term")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@_query("query_terms", "SELECT DISTINCT id, array_to_string(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]{2,}')[1:24], ' ') AS terms FROM mcp_queries")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").select("id", F.array_join(T.query_terms(F.col("query")), " ").alias("terms")).distinct()


@_query("cache_keys", rf"SELECT DISTINCT regexp_replace(lower({_strip('query')}), '\s+', ' ', 'g') || '|' || CASE WHEN reranked = 1 THEN 'true' ELSE 'false' END AS key FROM mcp_queries")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").select(T.cache_key(F.col("query"), F.col("reranked") == 1).alias("key")).distinct()


@_query("tag_names", f"SELECT DISTINCT doc_id, lower(regexp_replace({_strip('tag')}, '^/+|/+$', '', 'g')) AS tag FROM doc_tags WHERE regexp_replace({_strip('tag')}, '^/+|/+$', '', 'g') <> ''")
def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_tags").select("doc_id", T.tag_name(F.col("tag")).alias("tag")).where("tag is not null").distinct()


@_query("tag_lists", f"WITH l AS (SELECT doc_id, string_agg(DISTINCT tag, ' , ' ORDER BY tag) AS s FROM doc_tags GROUP BY doc_id) SELECT doc_id, len(list_filter(list_transform(string_split(s, ','), lambda t: {_strip('t')}), lambda t: t <> '')) AS n FROM l")
def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "doc_tags").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " , ").alias("s"))
    return joined.select("doc_id", F.size(T.tag_list(F.col("s"))).cast("long").alias("n"))


_AS_OF = 1767225600


@_query(
    "fresh_labels",
    f"""WITH t AS (SELECT id, CASE WHEN mtime >= 1420070400 AND mtime < 1767225600 THEN mtime WHEN mtime / 1e3 >= 1420070400 AND mtime / 1e3 < 1767225600 THEN mtime / 1e3 WHEN mtime / 1e6 >= 1420070400 AND mtime / 1e6 < 1767225600 THEN mtime / 1e6 END AS t FROM docs),
    d AS (SELECT id, ({_AS_OF} - t) / 86400 AS d, ({_AS_OF} - t) / 86400 * 86400 AS s FROM t WHERE t IS NOT NULL)
    SELECT id, CASE WHEN d < 1 THEN 'fresh' WHEN d < 7 THEN 'fresh ' || CAST(floor(d) AS BIGINT) || 'd' WHEN d < 30 THEN CAST(floor(d) AS BIGINT) || 'd' WHEN d < 365 THEN CAST(floor(d / 7) AS BIGINT) || 'w' ELSE CAST(floor(d / 365) AS BIGINT) || 'y' END AS label,
      CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS ago FROM d""",
)
def fresh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.lit(_AS_OF) - stored_seconds(F.col("mtime"))) / 86400
    docs = table(spark, sf_dir, "docs").where(age.isNotNull())
    return docs.select("id", T.fresh_label(age).alias("label"), T.relative_time(age * 86400).alias("ago"))


@_query(
    "short_numbers",
    "SELECT DISTINCT id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1fk', floor(n / 100) / 10) ELSE printf('%.1fM', floor(n / 100000) / 10) END AS label FROM (SELECT id, would_have_read_tokens AS n FROM mcp_queries WHERE would_have_read_tokens IS NOT NULL)",
)
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").where("would_have_read_tokens is not null").select("id", T.short_number(F.col("would_have_read_tokens")).alias("label")).distinct()


@_query("prefix_resolve", "WITH p AS (SELECT DISTINCT ext_id[1:4] AS prefix FROM docs WHERE ext_id IS NOT NULL) SELECT p.prefix, CASE WHEN count(DISTINCT d.ext_id) = 1 THEN min(d.ext_id) END AS ext_id FROM p JOIN docs d ON starts_with(d.ext_id, p.prefix) GROUP BY p.prefix")
def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each short id with the one full id it begins, null where several do. A prefix and its ids share their first four characters, so the join is an equi-join on those."""
    ids = table(spark, sf_dir, "docs").where("ext_id is not null").select("ext_id", F.substring("ext_id", 1, 4).alias("key"))
    asked = ids.select(F.col("key").alias("prefix"), F.col("key")).distinct()
    found = asked.join(ids, "key").where(F.startswith("ext_id", "prefix"))
    return found.groupBy("prefix").agg(F.when(F.count_distinct("ext_id") == 1, F.min("ext_id")).alias("ext_id"))


@_query("header_names", r"""SELECT DISTINCT id, coalesce(nullif(regexp_replace("user", '[^\p{L}\p{N}._-]', '', 'g')[1:32], ''), 'unknown') AS user_name, coalesce(nullif(regexp_replace(session_id, '[^\p{L}\p{N}._-]', '', 'g')[1:64], ''), 'unknown') AS session_name FROM mcp_queries""")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").select("id", T.header_name(F.col("user"), 32).alias("user_name"), T.header_name(F.col("session_id"), 64).alias("session_name")).distinct()


@_query("probe_lines", rf"SELECT id, list_filter(list_transform(string_split({_UNIX}, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 40 AND NOT regexp_matches(x, '^[#*|`-]'))[1][1:200] AS probe FROM docs WHERE content IS NOT NULL")
def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").where("content is not null").select("id", T.probe_line(F.col("content")).alias("probe"))


@_query(
    "scores_parsed",
    """WITH j AS (SELECT doc_id, 'note {"correctness": ' || n_chars || ', "safety": "x"} end' AS s FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id, CAST(greatest(0, least(100, coalesce(TRY_CAST(json_extract_string(regexp_extract(s, '(\\{.*\\})', 1), '$.correctness') AS INT), 0))) AS INT) AS correctness, 0 AS safety FROM j""",
)
def scores_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from the first {...} of a judge's answer, clamped to 0..100; what cannot be read counts 0."""
    said = F.concat(F.lit('note {"correctness": '), F.col("n_chars").cast("string"), F.lit(', "safety": "x"} end'))
    docs = table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", F.from_json(F.regexp_extract(said, r"(\{.*\})", 1), "correctness string, safety string").alias("j"))
    score = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col(c).try_cast("int"), F.lit(0))))
    return docs.select("doc_id", score("j.correctness").alias("correctness"), score("j.safety").alias("safety"))


@_query(
    "newer_versions",
    """WITH v AS (SELECT id, (id % 3) || '.' || (id % 12) || '.' || (id % 7) AS v FROM docs)
    SELECT id, v, list_transform(regexp_extract_all(v, '[0-9]+'), lambda x: CAST(x AS INT)) > [1, 9, 2] AS newer FROM v""",
)
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compared place by place as numbers, not as text."""
    i = F.col("id")
    v = table(spark, sf_dir, "docs").select("id", F.concat_ws(".", (i % 3).cast("string"), (i % 12).cast("string"), (i % 7).cast("string")).alias("v"))
    return v.withColumn("newer", T.version_parts(F.col("v")) > F.array(F.lit(1), F.lit(9), F.lit(2)))


@_query("palette_places", """SELECT u AS user, CAST(list_sum(list_transform(string_split(u, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END)) % 8 AS BIGINT) AS place FROM (SELECT DISTINCT "user" AS u FROM mcp_queries WHERE "user" IS NOT NULL AND "user" <> '')""")
def palette_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_queries").where("user is not null and user <> ''").select("user").distinct().select("user", T.palette_place(F.col("user"), 8).alias("place"))


@_query("breadcrumbs", "SELECT c.id, concat_ws(' > ', nullif(d.title, ''), nullif(c.heading_path, '')) || chr(10) || chr(10) || c.content AS embed_text FROM chunks c JOIN docs d ON d.id = c.doc_id")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a chunk to embed: title and headings, a blank line, the chunk."""
    d = table(spark, sf_dir, "docs").select(F.col("id").alias("doc_id"), "title")
    c = table(spark, sf_dir, "chunks").join(d, "doc_id")
    return c.select("id", F.concat(F.concat_ws(" > ", T.present(F.col("title")), T.present(F.col("heading_path"))), F.lit("\n\n"), F.col("content")).alias("embed_text"))


@_query("section_expand", "SELECT doc_id, heading_path, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS text FROM chunks GROUP BY doc_id, heading_path")
def section_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one heading path of a document joined in order; groups are as large as a document's section."""
    parts = table(spark, sf_dir, "chunks").where("content is not null").groupBy("doc_id", "heading_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))).alias("p"))
    return parts.select("doc_id", "heading_path", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("text"))


# Lines, fences, headings and sections in SQL.
_LINES = rf"""
WITH body AS (SELECT id, {_BODY} AS b FROM docs WHERE content IS NOT NULL),
raw AS (SELECT id AS doc_id, generate_subscripts(string_split(b, chr(10)), 1) - 1 AS n, unnest(string_split(b, chr(10))) AS line FROM body),
f AS (SELECT *, regexp_matches(line, '^\s*```') AS fence FROM raw),
g AS (SELECT *, fence OR coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM f),
h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^(#{{1,6}})\s+(\S.*?)(?:\s+#+)?\s*$') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level,
  regexp_extract(line, '^(#{{1,6}})\s+(\S.*?)(?:\s+#+)?\s*$', 2) AS title FROM g),
"""
SECTIONS = (
    _LINES
    + "s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section, "
    + ", ".join(f"max(CASE WHEN level = {k} THEN {{'n': n, 't': title}} END) OVER w AS at{k}" for k in range(1, 7))
    + " FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, concat_ws(' > ', "
    + ", ".join(f"CASE WHEN at{k}.n > greatest(-1, {', '.join(f'coalesce(at{j}.n, -1)' for j in range(1, k)) or '-1'}) THEN at{k}.t END" for k in range(1, 7))
    + f""") AS path FROM s),
q AS (SELECT doc_id, section, max(path) AS heading_path, {_strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE level = 0), '')")} AS text FROM p GROUP BY doc_id, section),
sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS section_no, heading_path, text FROM q WHERE text <> '')
"""
)


@_query("table_of_contents", _LINES + """t AS (SELECT doc_id, n, level, title, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM h WHERE level > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY n) AS k FROM t)
SELECT doc_id, n, least(level + 1, 6) AS level, title, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS anchor FROM k""")
def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.table_of_contents(table(spark, sf_dir, "docs"))


@_query("markdown_sections", SECTIONS + "SELECT doc_id, section_no, heading_path, text FROM sec")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(table(spark, sf_dir, "docs"))


def _pieces(text: str, of: str = "documents", key: str = "doc_id") -> str:
    size = lambda x: f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END"
    return f"""
paras AS (SELECT {key}, {text} AS whole, regexp_split_to_array({_strip(text)}, '\\n\\s*\\n') AS ps FROM {of} WHERE {text} IS NOT NULL),
walk AS (
  SELECT {key}, ps, 1 AS i, ps[1] AS piece, 1 AS piece_no, {size("ps[1]")} AS tok FROM paras WHERE {size(_strip("whole"))} > 450
  UNION ALL
  SELECT {key}, ps, i + 1, CASE WHEN tok + {size("ps[i + 1]")} > 450 THEN ps[i + 1] ELSE piece || chr(10) || chr(10) || ps[i + 1] END,
    CASE WHEN tok + {size("ps[i + 1]")} > 450 THEN piece_no + 1 ELSE piece_no END, CASE WHEN tok + {size("ps[i + 1]")} > 450 THEN {size("ps[i + 1]")} ELSE tok + {size("ps[i + 1]")} END
  FROM walk WHERE i < len(ps)),
done AS (
  SELECT {key}, piece_no, {_strip("arg_max(piece, i)")} AS piece FROM walk GROUP BY {key}, piece_no
  UNION ALL SELECT {key}, 1, {_strip("whole")} FROM paras WHERE {size(_strip("whole"))} <= 450)
"""


@_query("markdown_chunks", SECTIONS.replace("WITH", "WITH RECURSIVE", 1).rstrip() + "," + _pieces("text", "sec", "doc_id, section_no, heading_path") + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, piece_no) - 1 AS chunk_index, heading_path, piece AS content FROM done WHERE piece <> ''")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.chunks(table(spark, sf_dir, "docs"))


@_query("split_to_size", "WITH RECURSIVE " + _pieces("text") + "SELECT doc_id, piece_no - 1 AS piece_no, piece FROM done WHERE piece <> ''")
def split_to_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.packed(F.col("text"), 450)).alias("piece_no", "piece"))


_SPAN = (
    _LINES
    + """a AS (SELECT *, min(CASE WHEN level > 0 AND lower(title) = 'checks' THEN {'n': n, 'l': level} END) OVER (PARTITION BY doc_id) AS s FROM h),
b AS (SELECT *, min(CASE WHEN n > s.n AND level BETWEEN 1 AND s.l THEN n END) OVER (PARTITION BY doc_id) AS e FROM a WHERE s IS NOT NULL),
o AS (SELECT *, n >= s.n AND (e IS NULL OR n < e) AS own FROM b)
"""
)


@_query("section_extract", _SPAN + f"SELECT doc_id, {_strip('string_agg(line, chr(10) ORDER BY n)')} AS section FROM o WHERE own GROUP BY doc_id")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.extract_section(table(spark, sf_dir, "docs"), "## Checks")


@_query("section_replace", _SPAN + f"SELECT doc_id, {_strip("string_agg(CASE WHEN own THEN '## Checks' || chr(10) || 'None.' ELSE line END, chr(10) ORDER BY n)")} || chr(10) AS content FROM o WHERE NOT own OR n = s.n GROUP BY doc_id")
def section_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.replace_section(table(spark, sf_dir, "docs"), "Checks", "## Checks\nNone.\n")


@_query("code_chunks")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the fenced code of documents, by its language."""
    return code.chunk_code(code.fenced_code(table(spark, sf_dir, "docs")), most=60)


@_query(
    "code_cover",
    _LINES + """m AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS mark FROM h WHERE fenced),
    b AS (SELECT doc_id, (mark - 1) // 2 AS block_no, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT fence), '') AS source FROM m GROUP BY ALL)
    SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, md5(source) AS digest, 0 AS over FROM b WHERE source <> ''""",
)
def code_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each fenced block put together again, and those over the budget that could have been cut."""
    chunks = code_chunks(spark, sf_dir)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), "")
    over = (F.char_length("content") >= 4 * 61) & (F.col("last_line") > F.col("first_line"))
    return chunks.groupBy("doc_id", "block_no").agg(F.md5(whole).alias("digest"), F.count_if(over).alias("over"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("log_lines", "SELECT DISTINCT CAST(id AS VARCHAR) AS ts, query AS path, response_tokens_est AS tokens_est, session_id FROM mcp_queries WHERE query IS NOT NULL")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log written as JSON lines with broken ones between, and read again."""
    log = table(spark, sf_dir, "mcp_queries").where("query is not null").select(F.col("id").cast("string").alias("ts"), F.col("query").alias("path"), F.col("response_tokens_est").alias("tokens_est"), "session_id").distinct()
    good = F.to_json(F.struct("ts", "path", "tokens_est", "session_id"))
    folder = _folder(spark, "log")
    log.select(F.explode(F.array(good, F.concat(F.lit("{broken "), "ts"))).alias("value")).write.text(folder)
    return files.read_log(spark, folder).where("ts is not null")


@_query("label_lines", "SELECT DISTINCT lower(query) AS query, unnest([CAST(id AS VARCHAR) || '.md', CAST(id + 1 AS VARCHAR) || '.md']) AS id FROM mcp_queries WHERE query IS NOT NULL AND NOT contains(query, '|') AND NOT starts_with(query, '#') AND NOT contains(query, chr(9)) AND query = trim(query) AND query <> ''")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written in both notations, with comments and blank lines between, and read again."""
    asked = table(spark, sf_dir, "mcp_queries").where("query is not null and not contains(query, '|') and not startswith(query, '#') and not contains(query, '\t') and query = trim(query) and query <> ''")
    mark = F.when(F.col("id") % 2 == 0, "\t").otherwise(" | ")
    line = F.concat(F.lower("query"), mark, F.col("id").cast("string"), F.lit(".md, "), (F.col("id") + 1).cast("string"), F.lit(".md"))
    folder = _folder(spark, "labels")
    asked.select(F.explode(F.array(line, F.lit("# a comment\t1.md"), F.lit(" "))).alias("value")).write.text(folder)
    return files.read_labels(spark, folder).distinct()


@_query("files_scanned", "SELECT 'notes' AS source_id, 'd' || (doc_id % 7) || '/' || doc_id || '.md' AS path, octet_length(encode(text)) AS size_bytes, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) BETWEEN 1 AND 20000 AND doc_id % 7 <> 3")
def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, some in a folder that is ignored, and scanned."""
    folder = _folder(spark, "files")
    size = F.octet_length("text")
    rows = spread(table(spark, sf_dir, "documents").where(size.between(1, 20000)).select("doc_id", "text"))
    files.written(rows.select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text"), folder)
    return files.scan(spark, folder, "notes", folders=("d3",)).select("source_id", "path", "size_bytes", "content_hash")
