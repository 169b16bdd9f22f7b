"""Hybrid retrieval: BM25 and dense candidates, fused and scored by freshness, status and importance."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestrata.functions.columns import plain, stored_seconds
from lodestrata.functions.text import fresh_label, snippet, tag_name
from lodestrata.operators.knn import best, nearest
from lodestrata.session import materialize, spread

#: Constants of Okapi BM25, of reciprocal rank fusion (ranks from 0), and of the scores.
K1, B, RRF, HALF_LIFE_DAYS, IMPORTANCE = 1.2, 0.75, 60, 90.0, 0.35
#: Weights of statuses; any other weighs 1.
STATUS_WEIGHTS = {"canonical": 1.0, "plan": 0.85, "stale": 0.5, "duplicate": 0.6, "superseded": 0.3}
#: Marks of statuses in a listing.
STATUS_MARKS = {"canonical": "★", "plan": "◯", "stale": "✗", "duplicate": "⚠", "superseded": "⤺"}
TERM = "[a-z0-9]{2,}"
#: Dimensions of the hashed bag of words.
DIM = 384


def _local(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """Rows as a local relation, whose values and size Spark knows; an Arrow table of none has to be told apart."""
    return spark.createDataFrame(rows if rows.num_rows else [], from_arrow_schema(rows.schema))


def query_frame(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(qid, query), numbered from 1, as a local relation, whose size Spark knows."""
    return _local(spark, pa.table({"qid": pa.array(range(1, len(queries) + 1), pa.int32()), "query": pa.array(queries, pa.string())}))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def searchable(docs: DataFrame) -> DataFrame:
    """Documents as retrieval sees them: id, title, text (title and body), source_id, kind ('doc' where null), lifecycle, status (plain, canonical where empty), at (seconds of mtime, null if unknown), importance, tokens_est, path."""
    status = F.coalesce(F.nullif(plain(F.col("status")), F.lit("")), F.lit("canonical"))
    text = F.concat_ws(" ", "title", "content")
    return docs.select("id", "title", text.alias("text"), "content", "source_id", F.coalesce("kind", F.lit("doc")).alias("kind"), F.coalesce("lifecycle", F.lit("active")).alias("lifecycle"), status.alias("status"), stored_seconds(F.col("mtime")).alias("at"), F.coalesce("importance", F.lit(0.0)).alias("importance"), F.coalesce("tokens_est", F.lit(0)).alias("tokens_est"), "path", "ext_id")


def visible(docs: DataFrame, archived: bool = False, duplicates: bool = False, kinds: list[str] | None = None, sources: list[str] | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """The documents in scope, before any limit: not pending deletion, archived or duplicate ones only if asked for, of the kinds and sources, with any of the tags (a frame (doc_id))."""
    out = docs.where("lifecycle <> 'pending_delete'")
    if not archived:
        out = out.where("lifecycle <> 'archived'")
    if not duplicates:
        out = out.where("status <> 'duplicate'")
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if sources:
        out = out.where(F.col("source_id").isin(sources))
    if tagged is not None:
        out = out.join(tagged.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return out


def resolve_scope(known: list[str], asked: str | None = None, pinned: str | None = None, default: str | None = None) -> list[str] | None:
    """The sources to search: the one asked for, else the pinned, else the default; '*' is all (None). An unknown one is an error."""
    scope = asked or pinned or default
    if scope in (None, "*"):
        return None
    if scope not in known:
        raise ValueError(f"unknown source {scope!r}; known are {', '.join(sorted(known))}")
    return [scope]


@dataclass(frozen=True)
class Index:
    """What is kept of a collection of texts, as tables: postings(term, id, tf, length of the text), lengths(id, length), and vectors(id, v) of the texts with terms."""

    postings: DataFrame
    lengths: DataFrame
    vectors: DataFrame


def indexed(docs: DataFrame, dim: int = DIM) -> Index:
    """The Index of documents(id, text), written to the shared folder.

    Texts are read and cut once, in Arrow batches. Postings are in order of
    their terms, the frequent ones spread over several files, so a search reads
    only the row groups of the terms it asks for. A text of no terms has length 0
    and is counted; a null id is not.
    """
    rows = spread(docs.select(F.col("id").cast("long").alias("id"), F.col("text").alias("text")).where("id is not null"))
    whole = materialize(rows.mapInArrow(_counted(dim), "id long, length long, terms array<string>, tfs array<int>, v array<float>"))
    pairs = whole.select("id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").alias("tf"), "length")
    return Index(materialize(pairs.repartitionByRange("term", "id").sortWithinPartitions("term", "id")), whole.select("id", "length"), whole.where("length > 0").select("id", "v"))


_COUNTED = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])


def _counted(dim: int):
    """Of batches of (id, text): the number of terms, the distinct ones with how often each occurs, and their hashed bag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(TERM).findall, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lengths, terms, tfs = [], [], []
                v = np.zeros((batch.num_rows, dim), np.float32)
                for k, text in enumerate(batch["text"]):
                    found = Counter(find((text.as_py() or "").lower()))
                    if len(known) > 1_000_000:
                        known.clear()
                    for t in found:
                        if t not in known:
                            known[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little") % dim
                    if found:
                        v[k] = np.bincount([known[t] for t in found], weights=list(found.values()), minlength=dim)
                    lengths.append(found.total()), terms.append(list(found)), tfs.append(list(found.values()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), lists], schema=_COUNTED)

    return run


#: Queries, and terms of them, up to which they are held by the driver and told to the scans; more of them stay tables.
TOLD = 2000


def _few(queries: DataFrame) -> pa.Table | None:
    """(id, text) of the queries with a known id if there are no more than TOLD, which Spark reads without a job where they are local."""
    rows = queries.select(F.col("qid").cast("long"), "query").limit(TOLD + 1).collect()
    known = [r for r in rows if r[0] is not None]
    return None if len(rows) > TOLD else pa.table({"id": pa.array([r[0] for r in known], pa.int64()), "text": pa.array([r[1] for r in known], pa.string())})


def _terms(queries: DataFrame, few: pa.Table | None) -> tuple[DataFrame, list[str] | None]:
    """(qid, term) of the queries' distinct terms, the first 24 of each; and all of them, if the queries are few."""
    if few is None:
        return queries.select(F.col("qid").cast("long").alias("qid"), F.explode(F.array_distinct(F.slice(_words(F.col("query")), 1, 24))).alias("term")), None
    pairs = [(i, t) for i, text in zip(few["id"].to_pylist(), few["text"].to_pylist()) for t in dict.fromkeys(re.findall(TERM, (text or "").lower())[:24])]
    local = pa.table({"qid": pa.array([i for i, _ in pairs], pa.int64()), "term": pa.array([t for _, t in pairs], pa.string())})
    return _local(queries.sparkSession, local), sorted({t for _, t in pairs})


def bm25(docs: DataFrame, queries: DataFrame, pool: int, index: Index | None = None) -> DataFrame:
    """(qid, id, score, rank) of the pool best documents(id) per query(qid, query) by Okapi BM25.

    Terms are runs of two or more of [a-z0-9] in lower case; a query has its
    distinct terms, the first 24. Only the postings of those are read from the
    index, which may be of more documents than are searched; without one,
    documents(id, text) are indexed first. Counts and lengths are those of the
    documents searched. Scores are rounded to 6 places, ties go to the smaller
    id.
    """
    index = index or indexed(docs)
    asked, told = _terms(queries, _few(queries))
    own = docs.select("id")
    postings = index.postings.join(asked.select("term").distinct(), "term", "left_semi") if told is None else index.postings.where(F.col("term").isin(told))
    # One row. The lists of query terms are broadcast if Spark finds them small, as it does for any but a huge set of queries.
    size = index.lengths.join(own, "id", "left_semi").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    hits = postings.join(own, "id", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "mean", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(idf, "term").join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return best(scored, "qid", "id", pool, "score").withColumn("qid", F.col("qid").cast("int"))


def hashed_terms(docs: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(id, dim, weight): the hashed bag of words of each text as a sparse unit vector; a term's dimension is the number in the first four bytes of its MD5, lowest first, modulo dim. Texts without terms have no rows."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(_words(F.col(text_col))).alias("term"))
    digest = F.md5("term")
    low_first = F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)])
    counts = words.withColumn("dim", F.pmod(F.conv(low_first, 16, 10).cast("long"), F.lit(dim)).cast("int")).groupBy("id", "dim").agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "id").select("id", "dim", (F.col("n") / F.col("norm")).alias("weight"))


def embedded(docs: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(id, v): the same bag of words as a vector of counts, in Arrow batches; texts without terms have no row."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_counted(dim), "id long, length long, terms array<string>, tfs array<int>, v array<float>").where("length > 0").select("id", "v")


def dense(docs: DataFrame, queries: DataFrame, pool: int, index: Index | None = None) -> DataFrame:
    """(qid, id, score, rank) of the pool documents(id) nearest to each query in the hashed bag of words; score is (1 + cosine) / 2. Documents that share nothing with a query are no candidates for it. Their vectors are the index's, or made first of documents(id, text); a block of them and of the queries is one matrix product."""
    vectors = index.vectors.join(docs.select("id"), "id", "left_semi") if index else embedded(docs)
    few = _few(queries)
    if few is None:
        near = nearest(vectors, embedded(queries, "qid", "query"), pool, itself=True)
    else:
        made = pa.Table.from_batches(list(_counted(DIM)(iter(few.to_batches()))), _COUNTED).filter(pc.field("length") > 0).select(["id", "v"])
        near = nearest(vectors, _local(queries.sparkSession, made), pool, itself=True, size=DIM * made.num_rows)
    near = near.where("similarity > 0")
    return near.select(F.col("id").cast("int").alias("qid"), F.col("neighbour").alias("id"), F.round((1 + F.col("similarity")) / 2, 7).alias("score"), "rank")


def near_texts(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank) of the k texts(id, text) nearest to each of queries(qid, query) in the hashed bag of words, whatever the number of queries and the type of their ids."""
    near = nearest(embedded(texts), embedded(queries, "qid", "query"), k, itself=True)
    return near.select(F.col("id").alias("qid"), F.col("neighbour").alias("id"), "rank")


def fuse(*ranked: DataFrame) -> DataFrame:
    """(qid, id, rrf): the sum of 1 / (60 + rank) over ranked lists (qid, id, rank), ranks from 0."""
    out = ranked[0].select("qid", "id", "rank")
    for other in ranked[1:]:
        out = out.unionByName(other.select("qid", "id", "rank"))
    return out.groupBy("qid", "id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf"))


def freshness(at: Column, as_of: float) -> Column:
    """1 for now, falling to a half; a document of unknown age counts as old as can be."""
    days = F.greatest(F.lit(0.0), (F.lit(float(as_of)) - at) / 86400)
    return F.coalesce(0.5 + 0.5 / (1 + days / HALF_LIFE_DAYS), F.lit(0.5))


def status_weight(status: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in STATUS_WEIGHTS.items():
        out = F.when(status == name, F.lit(weight)).otherwise(out)
    return out


def hybrid(docs: DataFrame, queries: DataFrame, as_of: float, limit: int = 5, filtered: bool = False, index: Index | None = None) -> DataFrame:
    """(qid, id, score, rank) of the best of searchable, visible documents: both candidate lists, each cut to a pool of five times the limit, and of 50 at least if the documents are filtered by kind, tag or source, before they are fused, times freshness, weight of status and importance."""
    pool = max(limit * 5, 50) if filtered else limit * 5
    index = index or indexed(docs)
    fused = fuse(bm25(docs, queries, pool, index), dense(docs, queries, pool, index))
    boost = freshness(F.col("at"), as_of) * status_weight(F.col("status")) * (1 + IMPORTANCE * F.col("importance"))
    scored = fused.join(docs.select("id", "at", "status", "importance"), "id").select("qid", "id", F.round(F.col("rrf") * boost, 9).alias("score"))
    return best(scored, "qid", "id", limit, "score")


def search_chunks(chunks: DataFrame, docs: DataFrame, queries: DataFrame, index: Index, limit: int = 5, kind: str | None = None, source: str | None = None, tagged: DataFrame | None = None, archived: bool = False) -> DataFrame:
    """(qid, id, doc_id, score) of all candidates among chunks(id, doc_id) of visible documents, of a kind, a source and with any of the tags (a frame (doc_id)) if asked for.

    The candidates of each list are six times the limit, 50 at least; with tags
    4096. All filters come before the pools are cut. score is the fused one,
    rounded to 9 places; best() cuts to the limit.
    """
    keep = visible(docs, archived, kinds=[kind] if kind else None, sources=[source] if source else None, tagged=tagged)
    own = chunks.select("id", "doc_id").join(keep.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    pool = 4096 if tagged is not None else max(limit * 6, 50)
    fused = fuse(bm25(own, queries, pool, index), dense(own, queries, pool, index))
    return fused.join(own, "id").select("qid", "id", "doc_id", F.round("rrf", 9).alias("score"))


def dense_above(docs: DataFrame, queries: DataFrame, as_of: float, floor: float, limit: int, index: Index | None = None) -> DataFrame:
    """Pointers on the absolute scale: dense score times freshness and weight of status, only those at the floor or above."""
    near = dense(docs, queries, limit * 5, index).select("qid", "id", F.col("score").alias("sim"))
    scored = near.join(docs.select("id", "at", "status"), "id").select("qid", "id", F.round(F.col("sim") * freshness(F.col("at"), as_of) * status_weight(F.col("status")), 6).alias("score"))
    return best(scored.where(F.col("score") >= floor), "qid", "id", limit, "score")


def boot_pointers(docs: DataFrame, tags: DataFrame, agent: str, queries: DataFrame, as_of: float, floor: float = 0.62, limit: int = 5, index: Index | None = None) -> DataFrame:
    """dense_above() among the documents tagged owner/<agent>, in lower case; an agent that owns nothing gets no rows."""
    own = tags.where(tag_name(F.col("tag")) == f"owner/{agent.lower()}").select(F.col("doc_id").alias("id")).distinct()
    return dense_above(docs.join(own, "id", "left_semi"), queries, as_of, floor, limit, index)


def best_per_document(hits: DataFrame, limit: int = 12, offset: int = 0) -> DataFrame:
    """Chunk hits (qid, id, doc_id, score) collapsed to the best chunk of each document, with the score as a share of the query's best, and a page of them per query."""
    first = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "id"))
    one = hits.withColumn("k", first).where("k = 1")
    one = one.withColumn("share", F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 6))
    return best(one, "qid", "doc_id", offset + limit, "score").where(F.col("rank") >= offset).select("qid", "doc_id", "id", "score", "share", "rank")


def facet_counts(hits: DataFrame, tags: DataFrame, active: list[str], limit: int = 12) -> DataFrame:
    """The tags of the documents hit (qid, doc_id), most frequent first, without the active ones."""
    counts = hits.select("qid", "doc_id").distinct().join(tags.select("doc_id", "tag").distinct(), "doc_id").where(~F.col("tag").isin(active)).groupBy("qid", "tag").agg(F.count("*").alias("n"))
    return best(counts, "qid", "tag", limit, "n")


def repaired_order(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, idx, place) of all candidates(qid, idx) in the order that answers(qid, answer), JSON arrays of indexes, give: repeated and unknown indexes are skipped, missing ones follow in their own order."""
    said = answers.select("qid", F.posexplode_outer(F.from_json("answer", "array<int>")).alias("pos", "idx")).groupBy("qid", "idx").agg(F.min("pos").alias("pos"))
    placed = candidates.join(said, ["qid", "idx"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("pos").asc_nulls_last(), "idx")
    return placed.select("qid", "idx", (F.row_number().over(order) - 1).alias("place"))


def term_overlap(query: Column, text: Column) -> Column:
    """A deterministic relevance: the share of the query's terms that the text holds; 0 for a query without terms."""
    q = F.array_distinct(_words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, _words(text))).cast("double"), F.size(q)), F.lit(0.0))


def rerank(hits: DataFrame, query: str, text: str, limit: int, scorer=term_overlap) -> DataFrame:
    """The limit best of hits(qid, id, rank, query, text) by an injected scorer of (query, text) columns, ties in the order they came; lists no longer than the limit keep their order."""
    sized = hits.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).withColumn("relevance", F.round(scorer(F.col(query), F.col(text)), 6))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("n") > limit, -F.col("relevance")), "rank")
    return sized.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < limit).select("qid", "id", "relevance", "place")


def summaries(rows: DataFrame, as_of: float) -> DataFrame:
    """(id, line) of rows(id, path, status, at, tokens_est, content): path, mark, age and size, and below it the start of the text if there is any."""
    mark = F.lit("")
    for name, sign in STATUS_MARKS.items():
        mark = F.when(F.col("status") == name, F.lit(sign)).otherwise(mark)
    head = F.concat("path", F.lit("  "), mark, F.lit(" "), F.coalesce(fresh_label((F.lit(as_of) - F.col("at")) / 86400), F.lit("")), F.lit("  ~"), F.col("tokens_est").cast("string"), F.lit("tok"))
    start = F.nullif(snippet(F.col("content")), F.lit(""))
    return rows.select("id", F.concat(head, F.coalesce(F.concat(F.lit("\n  "), start), F.lit(""))).alias("line"))


def listing(rows: DataFrame) -> DataFrame:
    """(id, line) of rows(id, path, status): the path padded to the longest, and the mark of its status."""
    mark = F.lit("")
    for name, sign in STATUS_MARKS.items():
        mark = F.when(F.col("status") == name, F.lit(sign)).otherwise(mark)
    longest = rows.agg(F.max(F.char_length("path")).alias("longest"))
    # One row.
    return rows.crossJoin(F.broadcast(longest)).select("id", F.concat(F.expr("rpad(path, longest, ' ')"), F.lit("  "), mark).alias("line"))
