"""Session helpers: defaults the operators rely on and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: bytes of input files that a task is dealt where its work must not grow with the input
SHARE = 8_000_000


def get_spark(app: str = "parlance", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings used in tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The session's own setting wins. Only a local session may fall back to a
    temporary folder; a cluster without a shared folder is an error, because
    executors could not read each other's checkpoint files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def use_utc(spark: SparkSession) -> None:
    """Time stamps carry no zone and are read as UTC, so the session must not shift them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes partitions and cuts lineage, survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Written as Parquet to the shared folder and read back. Like ``pinned``, but later plans
    know the table's size and read only the columns they use, and the folders of ``by`` they ask for."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shares(*frames: DataFrame) -> int:
    """The number of partitions that ``frames`` are dealt out to, by the size of the files they read.

    Frames without files, such as pinned ones, go by the shuffle setting.
    """
    spark = frames[0].sparkSession
    # names come as URIs and are read as patterns
    files = sorted({re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for frame in frames for f in frame.inputFiles()})
    if not files:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).head()[0]
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // SHARE))


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small driver-side table. Sent as Arrow, so Catalyst sees local data and its true size."""
    schema = DataType.fromDDL(ddl)
    columns = [pa.array([_plain(row[i], f.dataType) for row in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema=schema)


def _plain(value, data_type):
    """Tuples become named fields where the type is a struct."""
    if isinstance(data_type, StructType) and value is not None:
        return {f.name: v for f, v in zip(data_type, value)}
    return value
