"""Session defaults and the shared scratch location."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed settings: AQE splits skewed join partitions, also where that costs one more shuffle.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("recset")
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else the checkpoint folder set on the context, else
    a folder in the warehouse, which a cluster shares as well. A warehouse on the machine's own disk is refused unless
    everything runs on that machine: elsewhere each executor would write to its own disk."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/recset-work"
        if not sc.master.startswith("local") and (root.startswith("file:") or root.startswith("/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/recset-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write once as Parquet to the shared folder and read back. A lost executor costs a read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of `cut` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def share(df: DataFrame) -> DataFrame:
    """What several branches of a query read, computed once. It is written like `cut`: a cached frame would keep the whole
    plan below it, and plans that share inputs on several levels then grow with every branch."""
    return cut(df, "share")


def parts(df: DataFrame, size: int = 1 << 20) -> int:
    """How many partitions hold `size` bytes of df each, by the optimiser's estimate from the files (small, as they are
    compressed); no fewer than a shuffle has."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(-(-estimate // size), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n partitions by `keys`; where a shuffle has as many anyway, Spark deals as it likes."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


SHARES = 8  # how many tasks a key of very many rows is spread over


def dealt_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, n: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that holds each key once. Where n is more than a shuffle has, both sides are dealt into n
    partitions by key and one of SHARES shares of `by`, so that a task's rows grow neither with the table nor with one key;
    `lookup` has a row for each share then."""
    if n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.join(lookup, key, how)
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)))
    lookup = lookup.withColumn("_share", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SHARES)])))
    both = [key, "_share"]
    return rows.repartition(n, *both).join(lookup.repartition(n, *both), both, how).drop("_share")


def release(spark: SparkSession) -> None:
    """Drop everything that queries of this session have cached."""
    spark.catalog.clearCache()
