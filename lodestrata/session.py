"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made for local sessions that have none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master, whose executors all run on this machine, may fall back
    to a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or _own.get(context.applicationId)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _own[context.applicationId]


def work_folder(spark: SparkSession) -> str:
    """This application's folder within the shared one; clear() deletes it, and so does the end of the driver if the session still runs then."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/lodestrata-{context.applicationId}"
    if context.applicationId not in _cleared:
        _cleared.add(context.applicationId)
        atexit.register(_at_end, spark)
    return folder


_cleared: set[str] = set()
#: How often clear() was called: what is kept by name between calls is void after one.
generation = 0


def clear(spark: SparkSession) -> None:
    """Delete all that materialize() and the streams of this application wrote; no frame made from it can be read any more."""
    if spark._jsc is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    global generation
    generation += 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lodestrata-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_end(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # noqa: BLE001 - the session's machine may be gone by now
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage so that iterations do not grow the plan, survives the loss
    of an executor, and gives the optimizer the real size of what it joins.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/lodestrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that materialize() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    base = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("lodestrata-") and base.split(":", 1)[-1].strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_states(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that a frame reads, as they are now."""
    spark, out = df.sparkSession, []
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((file, state.getLen(), state.getModificationTime()))
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer splits than those, as a small table in one file has.

    For steps that cost far more a row than moving it does. A table of many
    splits, as any large one is, passes as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once an application, through the shared folder.

    They need not have it installed, nor the driver be started beside it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    path = f"{shared_folder(spark)}/lodestrata-{uuid.uuid4().hex}.zip"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)
