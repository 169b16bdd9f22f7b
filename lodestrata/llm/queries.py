"""Queries of the training-data operators over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.catalog import table
from lodestrata.llm import chunking, languages, mixing, packing, survivors, vector_graph
from lodestrata.functions.columns import source_name, tokens
from lodestrata.llm import near_duplicates as nd
from lodestrata.operators import knn
from lodestrata.plans.text import SECTIONS
from lodestrata.session import materialize


def _near_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "docs").select("id", "content", "source_id", "kind")
    return nd.near_duplicates(docs, "id", "content", [F.col("source_id"), F.coalesce("kind", F.lit("doc"))], tau=0.6, k=3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.alike_pairs(*_near_duplicates(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.duplicate_groups(*_near_duplicates(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "docs"), limit=450, overlap=40)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that had to be cut: those with a second piece."""
    return p2_pieces(spark, sf_dir).where("section_piece = 1").select("doc_id", "section_no", "heading_path")


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each section come to: its characters put together again, pieces over the limit, overlaps of less than 40 tokens where there is as much before, pieces in vain."""
    p = p2_pieces(spark, sf_dir)
    fresh = F.char_length("content") - F.col("overlap_chars")
    short = (F.col("section_piece") > 0) & (F.col("overlap_chars") < 160) & (F.col("start") > 0)
    return p.groupBy("doc_id", "section_no", "heading_path").agg(F.sum(fresh).alias("chars"), F.count_if((F.col("tokens_est") > 450) | (F.col("tokens_est") != F.greatest(F.lit(1), F.floor(F.char_length("content") / 4)))).alias("over"), F.count_if(short).alias("thin"), F.count_if(fresh <= 0).alias("vain"), (F.count("*") > 1).alias("cut"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the order of trust alone, which the model of the sources cannot give; p4_records has what the model judges true."""
    return survivors.most_trusted(survivors.claimed_rows(table(spark, sf_dir, "docs"))).select("group_id", "survivor_id", "title_id", "mtime_id")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "docs"))[0]


def p4_true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.judged(survivors.claimed_rows(table(spark, sf_dir, "docs")))[0].where("probability >= 0.5")


def p4_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.judged(survivors.claimed_rows(table(spark, sf_dir, "docs")))[1]


VECTORS = ("vec_docs", "vec_chunks")
#: Searches on the same shards and graphs. Near copies are the nearest of all, so a narrow beam reaches them and they share
#: their nearest centroids; all ten neighbours of any vector need a wide beam and more shards.
NEAR, ALL = {"at_least": 0.85, "gap": 0.12, "beam": 24}, {"gap": 0.35, "beam": 96}


def _each_vector_table(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    found = [of(knn.usable(table(spark, sf_dir, name))).select(F.lit(name).alias("vec_table"), "*") for name in VECTORS]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _each_vector_table(spark, sf_dir, lambda v: vector_graph.neighbours(v, k=10, **NEAR))
    return near.select("vec_table", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_vector_table(spark, sf_dir, lambda v: vector_graph.neighbours(v, k=10, **ALL))


def _hundredths(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select("id")


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_vector_table(spark, sf_dir, lambda v: vector_graph.neighbours(v, k=10, queries=_hundredths(v), **ALL))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table, against brute force for the ids divisible by 100: the share of the true ten nearest that p5_search finds, and of those of 0.85 or more that the search of p5_found does."""
    keys = ["vec_table", "id", "neighbour"]
    true = materialize(_each_vector_table(spark, sf_dir, lambda v: vector_graph.exact_neighbours(v, _hundredths(v), k=10)))
    wide = p5_search(spark, sf_dir).select(*keys, F.lit(1).alias("found"))
    near = _each_vector_table(spark, sf_dir, lambda v: vector_graph.neighbours(v, k=10, **NEAR)).select(*keys, F.lit(1).alias("met"))
    both = true.join(wide, keys, "left").join(near, keys, "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)))
    close = F.col("similarity") >= 0.85
    return both.groupBy("vec_table").agg(F.count("*").alias("n_true"), share("found").alias("recall"), F.count_if(close).alias("n_near"), F.avg(F.when(close, F.coalesce("met", F.lit(0)))).alias("recall_near"))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_placed(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in twentieths of the capacity."""
    full = p6_placed(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return full.groupBy(F.floor(F.col("tokens") * 20 / 2048).alias("twentieths")).agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that is wrong if anything was placed wrongly: documents, pieces, tokens; containers over their capacity; documents torn though they fit, or not whole when put together; whether the containers are within a hundredth of the fewest possible."""
    placed = materialize(p6_placed(spark, sf_dir))
    full = placed.where("tokens > 0").groupBy("container_id").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > 2048).alias("overfull"), (F.count("*") <= F.ceil(F.sum("tokens") / 2048) * 1.01 + 2).alias("tight"))
    parts = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("start").alias("starts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    met = docs.join(parts, "doc_id", "left").agg(F.count("pieces").alias("n_docs"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n") < 4 * 2049)).alias("torn"), F.count_if(~F.col("chars").eqNullSafe(F.col("n")) | (F.col("starts") != F.col("pieces") * (F.col("pieces") - 1) / 2 * 8192)).alias("broken"))
    # One row each.
    return met.crossJoin(F.broadcast(full))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("outcome <> 'once'").select("source", "outcome")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a target source that is wrong if the draw was: complete passes, documents repeated otherwise than by the passes or one more, tokens drawn apart from the budget by more than the largest document, tokens that differ between sample and report."""
    sample, report = _mix(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("source"), tokens(F.col("text")).alias("size")).where("size > 0")
    met = docs.join(sample.select("doc_id", "repeats"), "doc_id", "left").join(report.select("source", "passes"), "source")
    times = F.coalesce("repeats", F.lit(0))
    by = met.groupBy("source").agg(F.count_if(~times.isin(F.col("passes"), F.col("passes") + 1)).alias("uneven"), F.max("size").alias("most"), F.sum(times * F.col("size")).alias("in_sample"))
    budget = F.when(F.col("outcome") == "short", 0.0).otherwise(F.col("need") - F.col("passes") * F.col("own"))
    off = (F.abs(F.col("fraction_tokens") - budget) > F.coalesce("most", F.lit(0))) & ((F.col("own") > 0) | (F.col("fraction_tokens") > 0))
    return report.join(by, "source", "left").select("source", "passes", F.coalesce("uneven", F.lit(0)).alias("uneven"), off.alias("off"), (F.coalesce("in_sample", F.lit(0)) == F.col("actual_tokens")).alias("agrees"))


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, samples = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")
    profiles = languages.refit_profiles(languages.fit_profiles(samples), samples, docs)
    return docs, languages.language_segments(docs, profiles)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.relabelled(*_languages(spark, sf_dir)).select("doc_id", "segment_no", "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[1]


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_checks": p2_checks,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p4_true_values": p4_true_values,
    "p4_source_quality": p4_source_quality,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_search": p5_search,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_placed": p6_placed,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_sample": p7_sample,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}

_TOKENS = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
_TARGETS = f"""
WITH sized AS (
  SELECT {_TOKENS} AS tokens, regexp_replace(regexp_replace(lower(trim(source)), '/+$', ''), '[ _]', '-', 'g') AS source FROM documents),
t AS (
  SELECT m.source, m.max_repeats, m.target_share * (SELECT sum(tokens) FROM sized) AS need,
    coalesce((SELECT sum(tokens) FROM sized s WHERE s.source = m.source), 0) AS own FROM mix_targets m)
"""
_GROUPS = """
WITH RECURSIVE e AS (
  SELECT d.id AS a, d.dup_of_id AS b FROM docs d JOIN docs o ON o.id = d.dup_of_id WHERE d.id <> d.dup_of_id
  UNION SELECT d.dup_of_id, d.id FROM docs d JOIN docs o ON o.id = d.dup_of_id WHERE d.id <> d.dup_of_id),
reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
grouped AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a),
timed AS (
  SELECT g.group_id, d.id, lower(trim(coalesce(d.status, ''))) AS status, lower(trim(coalesce(d.title, ''))) AS title,
    CASE WHEN mtime >= 1420070400 AND mtime < 1767225600 THEN mtime
         WHEN mtime / 1e3 >= 1420070400 AND mtime / 1e3 < 1767225600 THEN mtime / 1e3
         WHEN mtime / 1e6 >= 1420070400 AND mtime / 1e6 < 1767225600 THEN mtime / 1e6 END AS at_
  FROM docs d JOIN grouped g ON g.id = d.id),
ranked AS (
  SELECT *, CASE status WHEN 'canonical' THEN 0 WHEN 'plan' THEN 1 WHEN 'duplicate' THEN 2 WHEN 'stale' THEN 3 WHEN 'superseded' THEN 4 ELSE 5 END AS trust FROM timed),
placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust, at_ DESC NULLS LAST, id DESC) AS k FROM ranked)
"""
_COSINES = """
WITH usable AS (
  SELECT t, id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM (
    SELECT 'vec_docs' AS t, id, embedding FROM vec_docs UNION ALL SELECT 'vec_chunks', id, embedding FROM vec_chunks)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.t, a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM usable a JOIN usable b ON a.t = b.t AND a.id <> b.id),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY t, id ORDER BY s DESC, other) <= 10)
"""
_ALIKE = """
WITH worded AS (SELECT id, source_id, coalesce(kind, 'doc') AS kind, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM docs WHERE content IS NOT NULL),
sets AS (SELECT id, source_id, kind, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM worded WHERE len(w) >= 3),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS c FROM sets a JOIN sets b
  ON a.source_id IS NOT DISTINCT FROM b.source_id AND a.kind = b.kind AND a.id < b.id AND least(len(a.s), len(b.s)) >= 0.6 * greatest(len(a.s), len(b.s)))
SELECT id_a, id_b FROM pairs WHERE c >= 0.6 * (n + m - c)"""
ORACLES = {
    "p1_found": _ALIKE,
    "p2_found": SECTIONS + "SELECT doc_id, section_no, heading_path FROM sec WHERE length(text) // 4 > 450",
    "p2_checks": SECTIONS + "SELECT doc_id, section_no, heading_path, length(text) AS chars, 0 AS over, 0 AS thin, 0 AS vain, length(text) // 4 > 450 AS cut FROM sec",
    "p6_checks": f"SELECT count(*) AS n_docs, CAST(sum(greatest(1, ceil((coalesce(length(text), 0) - 3) / 8192))) AS BIGINT) AS n_pieces, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, 0 AS torn, 0 AS broken, 0 AS overfull, true AS tight FROM documents",
    "p7_checks": _TARGETS + "SELECT source, CASE WHEN need > max_repeats * own THEN max_repeats WHEN own > 0 THEN CAST(floor(need / own) AS BIGINT) ELSE 0 END AS passes, 0 AS uneven, false AS off, true AS agrees FROM t",
    "p5_found": _COSINES + "SELECT DISTINCT t AS vec_table, least(id, other) AS id_a, greatest(id, other) AS id_b FROM top WHERE s >= 0.85",
    "p4_found": _GROUPS
    + """SELECT group_id, max(id) FILTER (WHERE k = 1) AS survivor_id, arg_min(id, k) FILTER (WHERE title NOT IN ('', 'untitled')) AS title_id,
      arg_max(id, (at_, id)) FILTER (WHERE at_ IS NOT NULL) AS mtime_id FROM placed GROUP BY group_id""",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p7_found": _TARGETS + "SELECT source, CASE WHEN need > max_repeats * own THEN 'short' ELSE 'repeat' END AS outcome FROM t WHERE need > own OR need > max_repeats * own",
}
