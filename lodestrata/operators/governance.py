"""Keeping a corpus in order: duplicates, one document per topic, importance, orphans and capacity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import slug
from lodestrata.operators.components import connected_components

#: Kinds that come and go and are never judged duplicates.
EPHEMERAL = ("record", "checkpoint", "resume")
#: Base of importance by status; any other has 0.5.
BASE = {"canonical": 1.0, "plan": 0.6, "stale": 0.2, "duplicate": 0.0, "superseded": 0.0}
#: Vectors of a source beyond which search by brute force is warned of, for chunks and for documents.
CHUNK_LIMIT, DOC_LIMIT, WARN_AT = 4096, 100_000, 0.8


def _drivers(docs: DataFrame) -> DataFrame:
    """The documents that can make others duplicates, or become some: those that still stand."""
    return docs.where(F.col("status").isin("canonical", "plan"))


def duplicate_rule(pairs: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, dup_of, cosine): documents that a strictly newer one (by at, then id) of their kind resembles, each with the one most similar, the newest on a tie.

    pairs and members as knn.similar_classes() gives them; docs(id, at, status),
    an unknown time as the oldest. Only canonical documents and plans take part.
    Of a class of copies only the newest can be what another is a duplicate of,
    so each document meets one row of every class like its own.
    """
    key = F.struct(F.coalesce("at", F.lit(float("-inf"))).alias("at"), F.col("id"))
    known = members.join(_drivers(docs).select("id", key.alias("age")), "id")
    newest = known.groupBy("class_id").agg(F.max("age").alias("newest"))
    both = pairs.select("id_a", "id_b", "cosine").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cosine"))
    own = newest.select(F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b"), F.lit(1.0).alias("cosine"))
    like = both.unionByName(own).join(newest.toDF("id_b", "newest"), "id_b")
    # Of the classes like a document's own, the best whose newest is newer than it.
    met = known.join(like.withColumnRenamed("id_a", "class_id"), "class_id").where(F.col("newest") > F.col("age"))
    return met.groupBy("id").agg(F.max(F.struct("cosine", "newest")).alias("m")).select("id", F.col("m.newest.id").alias("dup_of"), F.col("m.cosine").alias("cosine"))


def duplicate_greedy(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, dup_of): the sequential rule. In order of id, every document not yet a duplicate marks one pair: it and its nearest neighbour that is none, of which the older becomes a duplicate of the newer.

    Only documents connected by pairs can affect each other, so each connected
    component is walked on its own, over its pairs and not its documents' texts.
    Only canonical documents and plans take part.
    """
    known = _drivers(docs).select("id")
    pairs = pairs.join(known.toDF("id_a"), "id_a", "left_semi").join(known.toDF("id_b"), "id_b", "left_semi")
    groups = connected_components(pairs, "id_a", "id_b")
    at = docs.select("id", F.coalesce("at", F.lit(float("-inf"))).alias("at"))
    rows = pairs.join(groups.select(F.col("id").alias("id_a"), "component"), "id_a").join(at.toDF("id_a", "at_a"), "id_a").join(at.toDF("id_b", "at_b"), "id_b")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        age: dict[int, tuple] = {}
        for a, b, s, ta, tb in zip(pdf["id_a"], pdf["id_b"], pdf["cosine"], pdf["at_a"], pdf["at_b"], strict=True):
            near.setdefault(a, []).append((-s, b))
            near.setdefault(b, []).append((-s, a))
            age[a], age[b] = (ta, a), (tb, b)
        gone: dict[int, int] = {}
        for one in sorted(near):
            if one in gone:
                continue
            other = next((o for _, o in sorted(near[one]) if o not in gone), None)
            if other is not None:
                old, new = sorted((one, other), key=age.get)
                gone[old] = new
        return pd.DataFrame({"id": list(gone), "dup_of": list(gone.values())}, dtype="int64")

    return rows.select("component", "id_a", "id_b", "cosine", "at_a", "at_b").groupBy("component").applyInPandas(walk, "id long, dup_of long")


def exact_copies(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(id, dup_of): documents whose text another with a smaller id has too."""
    digest = F.sha2(text_col, 256)
    rows = docs.where(F.col(text_col).isNotNull()).select("id", digest.alias("digest"))
    least = rows.groupBy("digest").agg(F.min("id").alias("dup_of"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, "digest").where("id <> dup_of").select("id", "dup_of")


def topic_winners(docs: DataFrame) -> DataFrame:
    """(id, topic, winner, new_status): of the documents of one workspace and topic the canonical, then newest, then last id wins; the rest become its duplicates. The topic is the stored one, else the slug of the title."""
    topic = F.coalesce("canonical_topic", slug(F.col("title")))
    rows = docs.withColumn("topic", topic).where("topic is not null and status <> 'superseded'")
    # An aggregate that combines before the shuffle, and a join of one row a topic, so that a topic of very many documents is in no one task.
    place = F.struct(F.col("status") == "canonical", F.coalesce("at", F.lit(float("-inf"))), "id")
    won = rows.join(rows.groupBy("workspace_id", "topic").agg(F.max_by("id", place).alias("winner")), ["workspace_id", "topic"])
    return won.select("id", "topic", "winner", F.when(F.col("id") == F.col("winner"), F.col("status")).otherwise("duplicate").alias("new_status"))


def superseded(docs: DataFrame) -> DataFrame:
    """(id, new_status, new_lifecycle): among live documents of a workspace and topic only the newest stays."""
    rows = docs.where("canonical_topic is not null and status = 'canonical' and lifecycle = 'active'")
    keys = ["workspace_id", "canonical_topic"]
    newest = rows.groupBy(*keys).agg(F.max_by("id", F.struct(F.coalesce("at", F.lit(float("-inf"))), "id")).alias("newest"))
    return rows.join(newest, keys).where("id <> newest").select("id", F.lit("superseded").alias("new_status"), F.lit("archived").alias("new_lifecycle"))


def metadata_drift(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose copied columns differ from their document's, nulls as values, with what they should be."""
    d = docs.select("id", F.coalesce("kind", F.lit("doc")).alias("doc_kind"), F.col("lifecycle").alias("doc_lifecycle"), F.col("status").alias("doc_status"))
    met = vectors.select("id", "kind", "lifecycle", "status").join(d, "id")
    same = F.col("kind").eqNullSafe(F.col("doc_kind")) & F.col("lifecycle").eqNullSafe(F.col("doc_lifecycle")) & F.col("status").eqNullSafe(F.col("doc_status"))
    return met.where(~same)


def importance(status: Column, pinned: Column, hits: Column) -> Column:
    """Base of the status, 1 for a pin, and up to a half for hits, rounded half to even at 4 places."""
    base = F.lit(0.5)
    for name, value in BASE.items():
        base = F.when(status == name, F.lit(value)).otherwise(base)
    return F.bround(base + F.when(pinned == 1, 1.0).otherwise(0.0) + 0.5 * F.least(F.lit(1.0), F.coalesce(hits, F.lit(0)) / 10), 4)


def recomputed_importance(docs: DataFrame, results: DataFrame) -> DataFrame:
    hits = results.groupBy("path").agg(F.count("*").alias("hits"))
    return docs.join(hits, "path", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"), importance(F.col("status"), F.col("pinned"), F.col("hits")).alias("importance"))


def orphans(children: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a child table whose document is gone."""
    return children.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def capacity(doc_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """Vectors per source, the share of the limit they use, and whether that calls for a warning."""
    d = doc_vectors.groupBy("source_id").agg(F.count("*").alias("docs"))
    c = chunk_vectors.groupBy("source_id").agg(F.count("*").alias("chunks"))
    both = d.join(c, "source_id", "full_outer").select("source_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    by_chunk = F.round(F.col("chunks") / CHUNK_LIMIT, 3)
    by_doc = F.round(F.col("docs") / DOC_LIMIT, 3)
    return both.withColumns({"chunk_ratio": by_chunk, "doc_ratio": by_doc}).withColumn("warning", F.when(by_chunk >= WARN_AT, "chunks").when(by_doc >= WARN_AT, "docs"))


def prune_listing(docs: DataFrame, status: str) -> DataFrame:
    """Documents of a status beside the one they name as theirs; orphaned where that does not exist."""
    of = docs.select(F.col("id").alias("dup_of_id"), F.col("path").alias("kept_path"))
    return docs.where(F.col("status") == status).select("id", "path", "dup_of_id").join(of, "dup_of_id", "left").select("id", "path", "dup_of_id", "kept_path", F.col("kept_path").isNull().alias("orphaned"))


def collapsed_owners(tags: DataFrame) -> DataFrame:
    """(doc_id): documents to drop as forks of an owner. Of tags owner/<name> and owner/<name>-<n> those with a number go if the bare one exists, else all but the highest; a document with any tag that stays is kept."""
    owner = tags.where(F.col("tag").rlike("^owner/.+")).select("doc_id", "tag").distinct()
    owner = owner.withColumn("n", F.nullif(F.regexp_extract("tag", r"-(\d{1,9})$", 1), F.lit("")).cast("int")).withColumn("base", F.regexp_replace("tag", r"-\d{1,9}$", ""))
    whole = Window.partitionBy("base")
    stays = F.when(F.bool_or(F.col("n").isNull()).over(whole), F.col("n").isNull()).otherwise(F.col("n") == F.max("n").over(whole))
    marked = owner.withColumn("stays", stays)
    return marked.where("not stays").select("doc_id").distinct().join(marked.where("stays").select("doc_id"), "doc_id", "left_anti")
