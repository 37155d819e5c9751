"""De-duplication, merging, list cleaning and id mapping."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recset.functions import columns as c
from recset.operators import ordering as o


def flag_duplicates(df: DataFrame, key: str, pos: str, ties: list[str] = ()) -> DataFrame:
    """`is_dup` marks all rows but the first one of their key by (pos, *ties): exactly one row of a key is no duplicate.

    Rows are numbered in buckets of the position, so a key with very many rows is not one task.
    """
    rows = o.ordinal(df, [key], [pos, *ties], o.id_bucket(df, pos), "_nth")
    return rows.withColumn("is_dup", (F.col("_nth") > 1).cast("int")).drop("_nth")


def merge_longest(df: DataFrame, key: str, texts: list[str], numbers: list[str], pos: str) -> DataFrame:
    """One row per key: the longest text (the first row wins ties) and the largest number of each column."""
    longest = lambda t: F.min(F.when(F.col(t).isNotNull(), F.struct(-F.length(t), F.col(pos), F.col(t).alias("t"))))["t"]
    return df.groupBy(key).agg(*[longest(t).alias(t) for t in texts], *[F.max(n).alias(n) for n in numbers])


def left_default(facts: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return facts.join(lookup, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def grouped_lists(df: DataFrame, key: list[str], item: str, order: Column, block: int, out: str) -> DataFrame:
    """Ordered lists of at most `block` items with a block number, so that a huge group becomes many rows.

    `order` is the dense 1-based position of the item in its group.
    """
    return (
        df.withColumn("_o", order).withColumn("block", F.floor((F.col("_o") - 1) / block).cast("long"))
        .groupBy(*key, "block")
        .agg(F.array_sort(F.collect_list(F.struct("_o", F.col(item).alias("v")))).alias("_s"))
        .select(*key, "block", F.transform("_s", lambda s: s["v"]).alias(out))
    )


def pair_counts(df: DataFrame, group: str, item: str, block: int = 64) -> DataFrame:
    """How many groups hold both items, for every pair a <= b that occurs together.

    The distinct items of a group are cut into hash blocks of about `block` items, and each task handles one pair of
    blocks; so a huge group is spread over many tasks, and counts are combined before the shuffle.
    """
    d = df.select(F.col(group).alias("_g"), F.col(item).alias("_v")).distinct()
    size = d.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias("_nb"))
    d = d.join(size, "_g").withColumn("_i", F.pmod(F.xxhash64("_v"), F.col("_nb")).cast("int"))
    blocks = d.groupBy("_g", "_nb", "_i").agg(F.collect_list("_v").alias("_a"))
    left = blocks.select("_g", F.col("_i").alias("_l"), F.col("_a").alias("_la"), F.explode(F.sequence(F.col("_i"), F.col("_nb") - 1)).alias("_i"))
    right = blocks.select("_g", "_i", F.col("_a").alias("_ra"))
    both = left.join(right, ["_g", "_i"]).select(F.explode("_la").alias("_x"), "_l", "_i", "_ra").select("_x", "_l", "_i", F.explode("_ra").alias("_y"))
    once = (F.col("_l") != F.col("_i")) | (F.col("_x") <= F.col("_y"))
    return both.filter(once).groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).agg(F.count("*").alias("n"))
