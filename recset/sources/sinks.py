"""Writers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def csv_semicolon(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", True).csv(path)


def dataset(df: DataFrame, path: str) -> None:
    """Split artefacts, partitioned so that a reader of one split scans that split only."""
    df.write.partitionBy("dataset", "setting", "split").parquet(path)


def rank_row(label: Column, qid: Column, values: Column) -> Column:
    """`label qid:<q> 1:v 2:v ...`"""
    pairs = F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string("%.6f", F.round(x, 6) + 0.0)))
    return F.concat_ws(" ", label.cast("string"), F.concat(F.lit("qid:"), qid.cast("string")), F.array_join(pairs, " "))
