"""A document store as functional updates: versions, tombstones, tags, listings and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, items: DataFrame, text_col: str = "content") -> DataFrame:
    """(ext_id, title, content, mtime, action) after items(ext_id, title, content, mtime) are written to store(same): 'unchanged' where title and text are the same, else 'updated' or 'added'; what is not written is 'kept'. A null time of an item keeps the stored one. Of items with one ext_id the latest counts."""
    last = Window.partitionBy("ext_id").orderBy(F.desc_nulls_last("mtime"), F.desc(F.sha2(F.coalesce(text_col, F.lit("")), 256)))
    new = items.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    both = store.alias("s").join(new.alias("i"), F.col("s.ext_id") == F.col("i.ext_id"), "full_outer")
    same = F.col("s.title").eqNullSafe(F.col("i.title")) & F.col(f"s.{text_col}").eqNullSafe(F.col(f"i.{text_col}"))
    action = F.when(F.col("i.ext_id").isNull(), "kept").when(F.col("s.ext_id").isNull(), "added").when(same, "unchanged").otherwise("updated")
    pick = lambda c: F.when(action.isin("added", "updated"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(F.coalesce("s.ext_id", "i.ext_id").alias("ext_id"), pick("title").alias("title"), pick(text_col).alias(text_col), F.coalesce(F.when(action.isin("added", "updated"), F.col("i.mtime")), F.col("s.mtime")).alias("mtime"), action.alias("action"))


def overwritten(store: DataFrame, items: DataFrame, text_col: str = "content") -> DataFrame:
    """(ext_id, title, content): what upsert() of the items overwrites, to be kept as versions."""
    gone = upsert(store, items, text_col).where("action = 'updated'").select("ext_id")
    return store.join(gone, "ext_id", "left_semi").select("ext_id", "title", text_col)


def version_listing(versions: DataFrame, text_col: str = "content") -> DataFrame:
    """(ext_id, version_id, title, ts, size, place) of versions(ext_id, version_id, title, content, ts), place 0 for a document's newest."""
    place = F.row_number().over(Window.partitionBy("ext_id").orderBy(F.desc("ts"), F.desc("version_id"))) - 1
    return versions.select("ext_id", "version_id", "title", "ts", F.char_length(text_col).alias("size"), place.alias("place"))


def restored(store: DataFrame, versions: DataFrame, picks: DataFrame, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(store, snapshots) after documents are rolled back to versions, as picks(ext_id, version_id) say.

    Only the text reverts; everything else of a document stays, and its text
    before is a snapshot(ext_id, title, content), so that it can be undone. A
    pick of no version of that document changes nothing. The store gains action,
    'restored' or 'kept'; of several picks of one document the largest counts.
    """
    one = picks.groupBy("ext_id").agg(F.max("version_id").alias("version_id"))
    found = versions.select("ext_id", "version_id", F.col(text_col).alias("_text")).join(one, ["ext_id", "version_id"]).where("_text is not null").select("ext_id", "_text").dropDuplicates(["ext_id"])
    both = store.join(found, "ext_id", "left")
    out = both.withColumn("action", F.when(F.col("_text").isNotNull(), "restored").otherwise("kept")).withColumn(text_col, F.coalesce("_text", text_col)).drop("_text")
    return out, both.where("_text is not null").select("ext_id", "title", text_col)


def newest_of_all(log: DataFrame, at: str, cap: int, *ties: str) -> DataFrame:
    """The cap newest rows of a whole log, by a top-k that keeps cap rows a task."""
    return log.orderBy(F.desc(at), *[F.desc(t) for t in ties]).limit(cap)


def undeleted(tombstones: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ext_id, title, content, kind, tags): the documents wanted(ext_id) as their latest tombstones(id, ext_id, title, content, kind, tags, deleted_at) have them, without the tags of a kind, which writing a document adds. Those without a tombstone have no row."""
    last = F.max_by(F.struct("title", "content", "kind", "tags"), F.struct("deleted_at", "id")).alias("t")
    found = tombstones.join(wanted.select("ext_id").distinct(), "ext_id", "left_semi").groupBy("ext_id").agg(last)
    return found.select("ext_id", "t.title", "t.content", "t.kind", F.filter("t.tags", lambda x: ~F.startswith(x, F.lit("kind/"))).alias("tags"))


def store_only(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, embeds, content_hash): whether documents have vectors. Those of the kinds are stored and found by words only; their hash is empty, so that they count as changed, and are embedded, when their kind changes. A null kind is none of them."""
    only = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    return docs.select("id", (~only).alias("embeds"), F.when(only, F.lit("")).otherwise(F.col("content_hash")).alias("content_hash"))


def newest(log: DataFrame, key: str, at: str, cap: int, *ties: str) -> DataFrame:
    """The cap newest rows of each key of an append-only log, with their place from 1."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(t) for t in ties]))
    return log.withColumn("place", k).where(F.col("place") <= cap)


def latest(log: DataFrame, key: str, at: str, tie: str, *values: str) -> DataFrame:
    """The values of the latest row of each key, by an aggregate that combines before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, tie)).alias("v")).select(key, "v.*")


def listing(docs: DataFrame, tags: DataFrame, kind: str | None = None, part: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of documents, the newest first, with their tags: only the page's tags are gathered."""
    rows = docs
    if kind:
        rows = rows.where(F.col("kind").eqNullSafe(kind))
    if part:
        rows = rows.where(F.contains(F.lower("path"), F.lit(part.lower())) | F.contains(F.lower("title"), F.lit(part.lower())))
    page = rows.orderBy(F.desc_nulls_last("at"), "id").offset(offset).limit(limit).select("id", "title", "status", "at")
    own = tags.join(page.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return page.join(own, "id", "left").select("id", "title", "status", "at", F.coalesce("tags", F.lit("")).alias("tags"))


def tag_counts(tags: DataFrame, limit: int | None = None) -> DataFrame:
    counts = tags.select("doc_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(limit) if limit else counts


def tag_facets(tags: DataFrame, other_limit: int = 12) -> DataFrame:
    """(facet, label, n): tags split at their first slash; those without one under '', the most frequent only."""
    counts = tag_counts(tags)
    split = F.instr("tag", "/")
    parts = counts.withColumn("facet", F.when(split > 0, F.substring_index("tag", "/", 1)).otherwise("")).withColumn("label", F.when(split > 0, F.expr("substring(tag, instr(tag, '/') + 1)")).otherwise(F.col("tag")))
    flat = parts.where("facet = ''").orderBy(F.desc("n"), "label").limit(other_limit)
    return parts.where("facet <> ''").unionByName(flat).select("facet", "label", "n")


def changed_tags(tags: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(doc_id, tag) after additions and removals; what is both added and removed is gone."""
    keys = ["doc_id", "tag"]
    return tags.select(*keys).unionByName(add.select(*keys)).distinct().join(remove.select(*keys).distinct(), keys, "left_anti")


def in_collections(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """(name, id) of collections(name, filter), the filter JSON {"kind", "source", "status"}; a field that is missing does not filter. Collections are matched on their fields, a missing one by a key of its own, so the join is an equi-join."""
    spec = collections.select("name", F.from_json("filter", "kind string, source string, status string").alias("f")).select("name", "f.*")
    any_ = "\u0000"
    keyed = spec.select("name", *[F.coalesce(c, F.lit(any_)).alias(c) for c in ("kind", "source", "status")])
    options = lambda c: F.array(F.coalesce(c, F.lit("")), F.lit(any_))
    rows = docs.select("id", options("kind").alias("kind"), options("source_id").alias("source"), options("status").alias("status"))
    for c in ("kind", "source", "status"):
        rows = rows.withColumn(c, F.explode(c))
    return rows.join(keyed, ["kind", "source", "status"]).select("name", "id").distinct()


def captured(turns: DataFrame, key: str, order: list[str], text: str, least: int = 20, tail: int = 24_000) -> DataFrame:
    """(key, transcript) of turns joined in order, the last characters of it; those of fewer than least are left out."""
    # Only the turns that reach into the tail are gathered, found by a running sum from the last one on.
    after = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    near = turns.where(F.col(text).isNotNull()).withColumn("_after", F.coalesce(F.sum(F.char_length(text) + 1).over(after), F.lit(0))).where(F.col("_after") <= tail)
    joined = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("t"))
    out = joined.select(key, F.array_join(F.transform("t", lambda x: x[text]), "\n").alias("transcript"))
    return out.where(F.char_length("transcript") >= least).withColumn("transcript", F.expr(f"right(transcript, {tail})"))
