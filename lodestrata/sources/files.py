"""Reading documents, logs and labels from files, and keeping snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.ingest import EXTENSIONS, MOST_BYTES, accepted

#: Folders and files that are never taken in.
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "__pycache__", ".venv")
SKIPPED_GLOBS = ("*.min.*", "*.lock")


def scan(spark: SparkSession, root: str, source_id: str, globs: tuple[str, ...] = (), folders: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(source_id, path, mtime, size_bytes, content, content_hash) of the accepted files below a root, paths relative to it.

    Files are listed first, without their contents, and names and sizes are
    judged; only the files that pass are opened. Their paths are held by the
    driver, as Spark's own listing of a folder is. On a local disk a link that
    leads out of the root is not followed.
    """
    ending = "*.{" + ",".join(EXTENSIONS) + "}"
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ending).load(root)
    named = listed.where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("whole"), relative.alias("path"), F.col("length").alias("size_bytes"))
    fine = [r["whole"] for r in accepted(named, [*SKIPPED_GLOBS, *globs], list(folders)).select("whole").collect() if _inside(r["whole"], base)]
    opened = spark.read.format("binaryFile").load(fine) if fine else listed.where("false")
    return opened.select(F.lit(source_id).alias("source_id"), relative.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def _inside(path: str, base: str) -> bool:
    """Whether a local file is below the root when links are followed; object stores have no links."""
    if not path.startswith("file:"):
        return True
    local = "/" + path.removeprefix("file:").lstrip("/")
    return os.path.realpath(local).startswith(os.path.realpath(base).rstrip("/") + "/")


def written(texts: DataFrame, root: str) -> None:
    """Write texts(path, text) as files below a root that all executors reach as a mounted folder; tasks write their own rows, and again if they are tried again."""
    folder = root.removeprefix("file://").removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                whole = os.path.join(folder, path)
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                with open(whole, "w", encoding="utf-8", newline="") as out:
                    out.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    texts.where("path is not null and text is not null").select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file, wherever Spark reads files, without blank lines and comments; none if there is no file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    # An ignore file is a few lines.
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#")]


def configured(spark: SparkSession, sources: list[dict], reserved: str, root: str | None = None) -> DataFrame:
    """(id, label, root) of configured sources; the reserved id and entries without id or root are left out, and a single root stands in for none."""
    rows = [(s["id"], s.get("label") or s["id"], s["root"]) for s in sources if s.get("id") and s.get("root") and s["id"] != reserved]
    if not rows and root:
        rows = [("code", "code", root)]
    return spark.createDataFrame(rows, "id string, label string, root string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, path, tokens_est, session_id) of a log of JSON lines; lines that cannot be read are skipped."""
    return spark.read.schema("ts string, path string, tokens_est long, session_id string").option("mode", "DROPMALFORMED").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query, id): labels written as a query, a tab or bar, and paths with commas between; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    parts = F.split("line", r"\s*[\t|]\s*", 2)
    paired = lines.select(F.try_element_at(parts, F.lit(1)).alias("query"), F.try_element_at(parts, F.lit(2)).alias("paths")).where("query <> '' and paths is not null")
    return paired.select("query", F.explode(F.split("paths", ",")).alias("id")).select("query", F.trim("id").alias("id")).where("id <> ''")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query, category, in_corpus, expected_docs) of JSON lines, comments skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    return lines.select(F.from_json("line", "query string, category string, in_corpus boolean, expected_docs array<string>").alias("c")).select("c.*").where("query is not null")


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write a snapshot under a name that sorts by time; names are never written twice."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Names of the snapshots in a folder, the newest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return sorted((s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()), reverse=True)


def prune_snapshots(spark: SparkSession, folder: str, keep: int = 7) -> list[str]:
    """Delete all but the newest snapshots; the names of those deleted."""
    old = snapshots(spark, folder)[keep:]
    for name in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return old
