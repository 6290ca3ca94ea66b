"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # whole texts: less memory on both sides
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset, in local mode only, a temporary one (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more: what was derived from it must have been staged itself."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; such rows never teach a model. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def distinct_sample(df: DataFrame, by: str, hashed: str, n: int) -> DataFrame:
    """(by, hashed) for at most n distinct values (n <= 1000 keeps Spark's early group limit) of column hashed in each value of by, those with the least hash.

    Only hashes are shuffled for the choice; the values that are broadcast are one row for each value of by.
    """
    keyed = df.where(F.col(by).isNotNull()).select(by, hashed, F.xxhash64(hashed, F.lit("sample")).alias("_h"))
    ids = keyed.select(by, "_h").distinct()
    least = Window.partitionBy(by).orderBy("_s", "_h")
    place = F.pmod("_h", F.lit(1 << 30))
    near = ids.join(F.broadcast(ids.groupBy(by).count()), by).withColumn("_s", place).where(F.col("_s") <= F.lit(float((1 << 30) * (4 * n + 100))) / F.col("count"))
    last = near.withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= n).groupBy(by).agg(F.max(F.struct("_s", "_h")).alias("_last"))
    chosen = keyed.join(F.broadcast(last), by).where(F.struct(place.alias("_s"), "_h") <= F.col("_last"))
    return chosen.groupBy(by, "_h").agg(F.min(hashed).alias(hashed)).select(by, hashed)
