"""Small frames with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns that carry names which operators use inside or return.
CLASH = "id string, words long, n_tokens string, ids binary, length string, start string, score string, bucket long, fingerprint int"

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "en er ch ei ge sch un ü ß au".split(), "fr": "le de é que eau ou on è ç ai".split()}


def prose(lang: str, n: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = [(i, prose(lang, rng.randint(3, 60), rng), lang, "a", 1) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    twin = out[7][1]
    out += [
        (100, None, "en", None, None), (101, "", None, "a", 0), (102, "   \n\t ", "en", "a", 3), (103, "12 345 !!", "de", "b", 9),
        (104, "x" * 5000, "en", "b", 5000), (105, twin, "de", "b", 1), (105, twin, "de", "b", 1), (None, twin, None, None, None),
        (106, prose("en", 4000, rng), "en", "c", 1), (107, "日本語 テキスト 😀\u0000 é ß İ", None, "c", 1), (108, "<|endoftext|> don't <s>", "en", "c", 1),
        (109, "a  b   c \n\n d\r\ne\u2581f", "en", "c", 1),
    ]
    return out


def documents(spark: SparkSession, extra: bool = False, empty: bool = False) -> DataFrame:
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    if extra:
        for c in CLASH.split(", "):
            name, kind = c.split(" ")
            if name not in df.columns:
                df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df
