"""Where results are kept: scratch folders, stored bars, and the tracker's trades as versions of one table."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = 100  # newest trades of a cell


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def write_bars(frame: DataFrame, path: str, mode: str = "append") -> None:
    """Bars by symbol, each symbol a folder, so that ``load_bars`` reads the wanted ones only."""
    frame.repartition("symbol").sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").mode(mode).parquet(path)


def write_json(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows as JSON lines, nulls written out, sorted by ``by`` within the files."""
    rows = frame.sortWithinPartitions(*by) if by else frame
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return files, []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return files, sorted(int(n.removeprefix("version=")) for n in done)


SCHEMA = "setup string, regime int, ts timestamp_ntz, r_multiple double"


def read_trades(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The trades of the newest whole version (below ``before``); none where there is no version."""
    _, versions = _versions(spark, path)
    versions = [v for v in versions if before is None or v < before]
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], SCHEMA)


def record_trades(path: str, kept: int = KEPT, versions: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of trades (SCHEMA) makes a new version of the newest ``kept`` ones of every cell.

    A version is named by its batch and made from the one before it, so a batch that is
    replayed writes the same version again and nothing is counted twice. A version
    counts once it is whole; only the last few are kept. A cell's rows are bounded, so
    a batch costs cells and new trades, not history.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        both = read_trades(spark, path, batch_id).unionByName(batch.select("setup", F.col("regime").cast("int").alias("regime"), F.col("ts").cast("timestamp_ntz").alias("ts"), "r_multiple"))
        newest = F.row_number().over(Window.partitionBy("setup", "regime").orderBy(F.desc("ts"), F.desc("r_multiple")))
        both.withColumn("k", newest).where(F.col("k") <= kept).drop("k").write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        files, have = _versions(spark, path)
        for old in [v for v in have if v < batch_id][: -(versions - 1) or None]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)

    return put


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report of bounded size as one JSON text."""
    spark.createDataFrame([(json.dumps(report, indent=2, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)
