"""The registered path queries against their full searches."""
import pytest

import __spark_entry__ as entry
from tests import harness as h

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["path_beam_topk", "path_viterbi", "path_combine"])
def test_paths_equal_full_search(spark, key):
    assert h.spark_rows(entry.queries()[key](spark, SF)) == h.duck_rows(h.connect(SF), entry.oracle_sql()[key])


def test_no_poi_pairs(spark):
    """Nothing in the plan joins POI with POI: classes meet classes, and POI their own class."""
    plan = entry.queries()["path_beam_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "cross" not in plan.lower() and "src" not in plan


def test_combine_has_every_pair(spark):
    """A weight for each ordered pair of two POI, not one for a class and a POI."""
    rows = entry.queries()["path_combine"](spark, SF).collect()
    poi = {r.dst for r in rows}
    assert len(poi) > 2 and sorted((r.src, r.dst) for r in rows) == sorted((a, b) for a in poi for b in poi if a != b)
