"""Helpers of the operators here: durable cuts of lineage and column handling."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and everything runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cellflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result depends on files only, so a lost executor costs no
    recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` returned and that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)``, null texts empty, whatever else the input carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hashed_sample(df: DataFrame, most: int, *cols: str) -> DataFrame:
    """At most about ``most`` rows, those whose hash of ``cols`` is low enough: the same ones in every run."""
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) < int(most / rows * (1 << 40)))


def buckets(spark: SparkSession, per_task: int = 4, amount: float = 0, each: float = 1) -> int:
    """Groups to deal out by hash: some for each shuffle partition, and so many that none has much more than ``each`` of ``amount``."""
    return max(16, per_task * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(amount // each) + 1)
