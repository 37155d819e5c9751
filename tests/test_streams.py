"""Batch handlers called directly, with events that come late."""
import random

from recset.operators import clean
from recset.streaming import streams as st


def by_hand(events, gap):
    """Pairs of consecutive events of a user that lie less than the gap apart."""
    out, last = [], {}
    for e, t, u, k in sorted(events, key=lambda x: (x[1], x[0])):
        if u in last and t - last[u][0] < gap:
            out.append((u, e, last[u][1], k))
        last[u] = t, k
    return sorted(out)


def feed_batches(spark, path, batches, gap, delay):
    handle = st.transition_batches(gap, delay)
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type")
        handle(batch, i, path)
        if i == 1:
            handle(batch, i, path)  # a batch that is run again gives the same
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    return sorted((r.user_id, r.event_id, r.src, r.dst) for r in read("pairs").collect()), read("late").agg({"dropped": "sum"}).first()[0]


def test_late_events_find_their_place(spark, tmp_path):
    """Events that come some batches late, but within the delay, give the pairs of the whole feed."""
    r = random.Random(3)
    events = [(i, r.randrange(3000), r.randrange(4), r.choice("abc")) for i in range(150)]
    events += [(900 + u, 9000, u, "z") for u in range(4)]  # later ones close all sessions
    arrival = sorted(events[:150], key=lambda e: e[1] + r.randrange(400))
    batches = [arrival[k : k + 30] for k in range(0, 150, 30)] + [events[150:], []]
    got, dropped = feed_batches(spark, str(tmp_path), batches, 60, 400)
    want = by_hand(events, 60)
    assert dropped == 0 and got == want and len(want) > 30
    # State of closed sessions is gone.
    assert spark.read.parquet(f"{tmp_path}/open/{len(batches) - 1}").count() == 4


def test_too_late_events_are_dropped_and_counted(spark, tmp_path):
    batches = [[(1, 0, 1, "a"), (2, 50, 1, "b"), (3, 1000, 2, "x")], [(4, 20, 1, "late"), (5, 1010, 2, "y")], [(6, 5000, 3, "end")], []]
    got, dropped = feed_batches(spark, str(tmp_path), batches, 100, 10)
    assert got == [(1, 2, "a", "b"), (2, 5, "x", "y")] and dropped == 1


def test_no_events(spark, tmp_path):
    assert feed_batches(spark, str(tmp_path), [[], []], 100, 10) == ([], 0)


def test_exactly_one_row_of_a_key_is_first(spark):
    rows = [(1, 5, "a"), (1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (None, 1, "d"), (None, 1, "e"), (3, None, "f"), (3, 2, "g")]
    df = spark.createDataFrame(rows, "id long, pos long, t string")
    got = clean.flag_duplicates(df, "id", "pos", ["t"]).collect()
    assert sorted((str(r.id), r.is_dup) for r in got) == [("1", 0), ("1", 1), ("1", 1), ("2", 0), ("3", 0), ("3", 1), ("None", 0), ("None", 1)]
    assert {r.t: r.is_dup for r in got if r.id == 3} == {"f": 0, "g": 1}
