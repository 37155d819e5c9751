"""The pipeline stage by stage against brute force on small tables."""
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from recset.llm.common import written
from tests.llm import edge
from tests.llm.test_decontamination import plain
from tests.llm.test_private_data import plain as plain_spans
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_token_ops import word_ids


def tables(spark, tmp_path, rows, extra=False):
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    if extra:
        docs = docs.selectExpr("*", "1 AS fp", "'x' AS lang_found", "2 AS component_id", "3 AS row_key", "4 AS pii_spans", "'y' AS id", "5 AS n_rows")
    rng = random.Random(9)
    items = [(1, edge.prose("en", 30, rng)), (2, edge.prose("fr", 12, rng)), (3, None)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs.columns, items


def corpus():
    rng = random.Random(9)
    item, _ = edge.prose("en", 30, rng), edge.prose("fr", 12, rng)
    rows = edge.rows()
    long = edge.prose("de", 300, rng).split()
    rows += [(200 + k, " ".join(long[:k] + ["neu"] + long[k + 1 :]), "de", "a", 1) for k in range(5)]
    rows += [(300, edge.prose("en", 20, rng) + " " + " ".join(item.split()[3:18]) + " end", "en", "a", 1), (301, " ".join(item.split()[:9]), "en", "a", 1)]
    rows += [(302, edge.prose("en", 30, rng) + " jo.1@mail.example.com and +1 (603) 555-8791 or 4111 1111 1111 1111 at 9.8.7.6", "en", "a", 1)]
    rows += [(None, edge.prose("fr", 25, rng), "fr", "a", 1), (None, item, None, "a", 1)]
    return rows


def has_letter(t):
    return any(c.isalpha() for c in t or "")


@pytest.mark.parametrize("extra", [False, True])
def test_run(spark, tmp_path, extra):
    rows = corpus()
    columns, items = tables(spark, tmp_path, rows, extra)
    sf, docs, after = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), "t")
        after.append(docs)
        if name != "packing":
            assert docs.columns == columns
    keys = lambda rs: sorted(((r[0], r[1]) for r in rs), key=str)
    # 1: documents without a letter go.
    kept = [r for r in rows if has_letter(r[1])]
    assert keys(after[0].collect()) == keys(kept)
    # 2: one document of each group stays.
    own = plain_components([r[0] for r in kept], [plain_fingerprint(r[1]) for r in kept])
    want, seen = [], set()
    for r, c in zip(kept, own):
        if r[0] == c and (c is None or c not in seen):
            seen.add(c)
            want.append(r)
    assert keys(after[1].collect()) == keys(want)
    # 3: documents with a benchmark passage go.
    clean = [r for r in want if not plain([(r[0], r[1])], items)[0][2]]
    assert keys(after[2].collect()) == keys(clean) and len(clean) < len(want)
    # 4: personal data is masked, and every document stays.
    masked = {r.doc_id: r.text for r in after[3].collect()}
    assert len(masked) == len({r[0] for r in clean}) and after[3].count() == len(clean)
    assert masked[302].endswith(" <EMAIL> and <PHONE> or <CARD> at <IP>")
    for r in clean:
        if not plain_spans(r[1]) and r[0] is not None:
            assert masked[r[0]] == r[1]
    # 5: every piece has its place.
    packed = after[4].collect()
    assert sum(r.length for r in packed) == sum(len(word_ids(r.text)) for r in after[3].collect())
    for r in packed:
        if r.doc_id is not None:
            ids = word_ids(masked[r.doc_id])
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_empty_and_registered(spark, tmp_path):
    _, _ = tables(spark, tmp_path, [])
    assert cp.run(spark, str(tmp_path)).count() == 0
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()
    assert os.path.exists(cp.__file__)
