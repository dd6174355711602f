"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Order of a row's columns in the table of documents.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Paths that `stored` has written, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or set as the checkpoint folder. On a cluster it must be
    set, since executors share no local folder; a local session without one (tests) gets its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="linemetry-")
        context.setCheckpointDir(found)
    return found


def write(df: DataFrame, path: str) -> None:
    """Write a DataFrame as Parquet; the files of its shuffles go as soon as it is written, not when the
    driver happens to collect garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to a new table in the shared folder and read it again: cuts the lineage,
    and what was written survives the loss of an executor; its shuffles leave the disk. `drop_stored`
    deletes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/linemetry/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        _written[spark.sparkContext.applicationId].remove(df._stored_at)
        _delete(spark, df._stored_at)


def drop_stored(spark: SparkSession) -> int:
    """Delete all tables that `stored` has written in this application; results that were made from
    them must have been read or written by then. Returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
