"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session names one; a new local folder only where it is
    unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="arborweb-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for root, spark in _made.items():
        try:
            remove(spark, root)
        except Exception:  # the session is gone; its folder stays for whoever owns the store
            pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a place of one's own, over what an interrupted write left there, and
    read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file ``path`` appear whole, unless it is there: then False. Of several writers
    one succeeds: the text is written beside it, and renamed as the store does without
    overwriting."""
    jvm = spark.sparkContext._jvm
    where, fs = _files(spark, path)
    if fs.exists(where):
        return False
    draft, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(draft, where, options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it is not there."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def _fresh(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/arborweb-{spark.sparkContext.applicationId}"
    _made[root] = spark
    return f"{root}/{uuid.uuid4().hex}"


def run_dir(spark: SparkSession) -> str:
    """A new folder of this application, for a stream's checkpoint or a run's tables."""
    return _fresh(spark)


def streamed(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source has no more, as a table in the shared folder; with
    ``update``, all versions of each row. Nothing of it comes to the driver."""
    spark = df.sparkSession
    out, state = run_dir(spark), run_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is done again after a loss writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, out):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def spooled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on the executors' disks, for a table that is read more
    than once and cheap to make again: what a lost executor held is computed anew."""
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over tasks evenly, for rows that are few bytes as read but much work: a row group of
    a file is one task's, and may hold a million of them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` spooled by ``keys``, in their order, for a table that is joined by them again and
    again: only what meets it is shuffled, and it is never broadcast, however small it looks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spooled(df.repartition(parts, *keys).sortWithinPartitions(*keys)).hint("merge")


def ranged(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored in the order of ``key``, for a table of which ranges are read (``met_in_range``)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, key).sortWithinPartitions(key))


def met_in_range(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a ``ranged`` table, of which only row groups between the least and the greatest
    key of the rows are read. The rows are read more than once."""
    least, most = rows.agg(F.min(key), F.max(key)).first()
    return rows.join(table.filter(F.col(key).between(least, most)).hint("merge"), key)


def stored(df: DataFrame, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: the lineage is cut, and a lost executor costs
    no recomputation of what stands above. With ``rows``, at most how many there are, it is
    written in files of a million. ``codec``: how Parquet compresses it, if not as the session
    says. This application's folder goes when the driver ends."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 1_000_000)))
    spark, path = df.sparkSession, _fresh(df.sparkSession)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
