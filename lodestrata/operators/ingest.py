"""Taking in files: what to accept, what changed, which chunks to embed again."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.columns import plain
from lodestrata.functions.text import document_title, name_title

#: Endings of the files that are taken in.
EXTENSIONS = ("md", "mdx", "markdown", "py", "go", "rs", "ts", "tsx")
MOST_BYTES = 1_000_000


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole path, its last name, or any folder it lies in, with or without a slash; * crosses slashes."""
    patterns = [fnmatch.translate(g).replace("(?s:", "").replace(r")\z", "").replace(r")\Z", "") for g in globs if g.strip() and not g.startswith("#")]
    if not patterns:
        return F.lit(False)
    either = "^(?s:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = F.when(F.size(parts) > 1, F.exists(folders, lambda f: f.rlike(either) | F.concat(f, F.lit("/")).rlike(either))).otherwise(False)
    return path.rlike(either) | F.element_at(parts, -1).rlike(either) | inside


def accepted(files: DataFrame, globs: list[str], folders: list[str], extensions: tuple[str, ...] = EXTENSIONS, most: int = MOST_BYTES) -> DataFrame:
    """Files(path, size_bytes) with a known ending, not too large, in no ignored folder and matched by no ignore pattern; a path that climbs out of its root is refused."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    parts = F.split("path", "/")
    fine = ending.isin(*extensions) & (F.coalesce("size_bytes", F.lit(0)) <= most) & ~F.arrays_overlap(parts, F.array(F.lit(".."), *map(F.lit, folders)))
    return files.where(fine & ~ignored(F.col("path"), globs))


def changes(snapshot: DataFrame, catalog: DataFrame, trust_mtime: bool = True) -> DataFrame:
    """(source_id, path, action, new_mtime) of a scan (source_id, path, mtime, content_hash) against what is known (same columns).

    An equal time is unchanged without looking at the hash, if times are trusted;
    else an equal hash is unchanged with the time refreshed, another is updated;
    what only the scan has is added, what only the catalog has removed.
    """
    s, c = snapshot.alias("s"), catalog.alias("c")
    both = s.join(c, (F.col("s.source_id") == F.col("c.source_id")) & (F.col("s.path") == F.col("c.path")), "full_outer")
    same_time = F.lit(trust_mtime) & F.col("s.mtime").eqNullSafe(F.col("c.mtime"))
    action = F.when(F.col("c.path").isNull(), "added").when(F.col("s.path").isNull(), "removed").when(same_time | F.col("s.content_hash").eqNullSafe(F.col("c.content_hash")), "unchanged").otherwise("updated")
    return both.select(F.coalesce("s.source_id", "c.source_id").alias("source_id"), F.coalesce("s.path", "c.path").alias("path"), action.alias("action"), F.col("s.mtime").alias("new_mtime"))


def changed_paths(snapshot: DataFrame, catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """The same for an explicit set of paths(source_id, path), whose times are not trusted: a path that the scan lacks is removed."""
    keys = ["source_id", "path"]
    own = paths.select(*keys).distinct()
    return changes(snapshot.join(own, keys, "left_semi"), catalog.join(own, keys, "left_semi"), trust_mtime=False)


def chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, digest, n, id, chunk_index, action) of chunks by content: of old(id, doc_id, text, chunk_index) and new(doc_id, text, chunk_index) the n-th of equal text in a document is reused, others are inserted (only those need embedding) or deleted."""

    def numbered(rows: DataFrame, tie: str) -> DataFrame:
        rows = rows.withColumn("digest", F.sha2("text", 256))
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("chunk_index", tie)))

    a = numbered(old, "id").select("doc_id", "digest", "n", "id")
    b = numbered(new, "digest").select("doc_id", "digest", "n", "chunk_index")
    both = a.join(b, ["doc_id", "digest", "n"], "full_outer")
    return both.withColumn("action", F.when(F.col("id").isNull(), "insert").when(F.col("chunk_index").isNull(), "delete").otherwise("reuse"))


def migrated(docs: DataFrame) -> DataFrame:
    """(id, ext_id, kind): file documents that are not blank as owned ones, their id made of source and path."""
    digest = F.sha1(F.concat_ws("|", "source_id", "path"))
    return docs.where("ext_id is null and trim(coalesce(content, '')) <> ''").select("id", F.concat(F.lit("mig_"), F.substring(digest, 1, 16)).alias("ext_id"), F.when(F.startswith("source_id", F.lit("vault")), "note").otherwise("reference").alias("kind"))


def retitled(docs: DataFrame) -> DataFrame:
    """(id, stored, title) of the documents(id, title, content, path) whose title is missing, empty or 'untitled': a title derived from the text, else from the path."""
    found = F.nullif(document_title(F.col("content")), F.lit("Untitled"))
    return docs.where(plain(F.col("title")).isin("", "untitled")).select("id", F.col("title").alias("stored"), F.coalesce(found, name_title(F.col("path"))).alias("title"))


def facet_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, tag) with flat tags promoted by mapping(tag, facet) to facet/tag; leads (…-lead) become role/lead beside that. Repeated rows once."""
    named = tags.join(mapping, "tag", "left").select("doc_id", F.when(F.col("facet").isNotNull(), F.concat_ws("/", "facet", "tag")).otherwise(F.col("tag")).alias("tag"), F.endswith("tag", F.lit("-lead")).alias("lead"))
    return named.select("doc_id", "tag").unionByName(named.where("lead").select("doc_id", F.lit("role/lead").alias("tag"))).distinct()


def folder_tags(docs: DataFrame) -> DataFrame:
    """(doc_id, tag): folder/<name> of every folder a document lies in, and origin/<source>."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    inside = docs.select(F.col("id").alias("doc_id"), F.explode(folders).alias("name")).where("name <> ''").select("doc_id", F.concat(F.lit("folder/"), F.lower("name")).alias("tag"))
    return inside.unionByName(docs.where("source_id is not null").select(F.col("id").alias("doc_id"), F.concat(F.lit("origin/"), "source_id").alias("tag"))).distinct()
