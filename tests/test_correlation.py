import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.skew import dealt, hot_keys, interval_join, numbered, row_numbers, running_totals
from tidewatch.operators import correlate as J
from tidewatch.streaming.correlation import stream_correlations

START = datetime(2024, 1, 1)
SCHEMA = "id string, detected_at timestamp, source string, severity string"


def now():
    return F.lit("2024-02-01").cast("timestamp")


def events(spark, *rows):
    return spark.createDataFrame([(i, START + timedelta(seconds=s), src, sev) for i, s, src, sev in rows], SCHEMA)


def one(spark, seconds, source="a", severity="high", other="high", **options):
    left = events(spark, ("l", 1000, "a", severity))
    right = events(spark, ("m", 1000 + seconds, source, other))
    return J.find_correlations(left, right, now(), min_confidence=0.0, **options).collect()


@pytest.mark.parametrize(
    ("seconds", "source", "severity", "other", "confidence"),
    [
        (0, "a", "critical", "high", 1.0),
        (300, "a", "critical", "critical", 0.6),
        (-300, "a", "critical", "critical", 0.6),
        (0, "b", "low", "low", 0.4 + 0.3 / 9),
        (150, "b", "medium", "HIGH", 0.2 + 0.3 * 6 / 9),
        (0, "b", "odd", "low", 0.4 + 0.3 / 9),
    ],
)
def test_confidence(spark, seconds, source, severity, other, confidence):
    got = one(spark, seconds, source, severity, other)
    assert [r.confidence for r in got] == [pytest.approx(confidence)]
    assert got[0].time_delta_sec == seconds


@pytest.mark.parametrize("seconds", [300.000001, -301, 600])
def test_outside_the_window(spark, seconds):
    assert one(spark, seconds) == []


def test_minimum_confidence(spark):
    left, right = events(spark, ("l", 0, "a", "low")), events(spark, ("m", 280, "b", "low"), ("n", 0, "a", "low"))
    got = J.find_correlations(left, right, now()).collect()
    assert [r.metric_event_id for r in got] == ["n"]


def test_missing_times_and_sources(spark):
    left = spark.createDataFrame([("l", None, START, None, "high")], "id string, detected_at timestamp, timestamp timestamp, source string, severity string")
    right = events(spark, ("m", 10, None, "high"))
    assert J.find_correlations(left, right, now()).first().time_delta_sec == 10.0


@pytest.mark.parametrize("rows_per_split", [3, 50, 20_000])
def test_crowded_buckets_against_brute_force(spark, rows_per_split):
    random.seed(rows_per_split)
    spots = [random.choice([100, 105, 110, 5000, 20_000]) + random.randint(0, 40) for _ in range(160)]
    left = [(f"l{i}", s, random.choice("ab"), random.choice(["low", "high"])) for i, s in enumerate(spots[:100])]
    right = [(f"m{i}", s, random.choice("ab"), random.choice(["low", "medium"])) for i, s in enumerate(spots[100:])]
    got = J.find_correlations(
        events(spark, *left), events(spark, *right), now(), window_seconds=30, min_confidence=0.0, rows_per_split=rows_per_split
    )
    got = sorted((r.log_event_id, r.metric_event_id) for r in got.collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if abs(a[1] - b[1]) <= 30)


def test_interval_join_with_negative_times(spark):
    left = spark.createDataFrame([(t,) for t in range(-20, 20)], "a long")
    right = spark.createDataFrame([(t,) for t in range(-20, 20)], "b long")
    got = sorted(tuple(r) for r in interval_join(left, right, "a", "b", 3, 5).select("a", "b").collect())
    assert got == sorted((a, b) for a in range(-20, 20) for b in range(-20, 20) if abs(a - b) <= 3)


def test_interval_join_plan_has_no_nested_loop(spark):
    left, right = events(spark, ("l", 0, "a", "high")), events(spark, ("m", 1, "a", "high"))
    plan = J.find_correlations(left, right, now())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_correlation_cycle(spark):
    as_of = START + timedelta(seconds=1000)
    rows = [("a", 990, "s", "high"), ("b", 900, "s", "high"), ("old", 100, "s", "high")]
    found = J.correlation_cycle(events(spark, *rows), as_of)
    assert sorted((r.log_event_id, r.metric_event_id) for r in found.collect()) == [("a", "b"), ("b", "a")]
    found = J.correlation_cycle(events(spark, *rows), as_of, allow_self=True)
    assert sorted((r.log_event_id, r.metric_event_id) for r in found.collect()) == [
        ("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")
    ]


def test_correlation_cycle_takes_all_anomalies_of_the_window(spark):
    rows = [(f"e{i}", 990 - i / 10, "s", "high") for i in range(500)]
    found = J.correlation_cycle(events(spark, *rows), START + timedelta(seconds=1000))
    assert found.count() == 500 * 499


def test_more_than_a_thousand_crowded_buckets(spark):
    times = [(t * 10 + k % 3,) for t in range(1500) for k in range(6)]
    left, right = spark.createDataFrame(times, "a long"), spark.createDataFrame(times, "b long")
    assert hot_keys(left.withColumn("k", F.floor(F.col("a") / 5)), ["k"], 4).count() == 1500
    assert interval_join(left, right, "a", "b", 5, 4).count() == 1500 * 36


def test_running_totals_against_brute_force(spark):
    random.seed(2)
    rows = [(random.choice("abc"), random.randint(0, 500), i, random.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, i long, n long").withColumn("cell", F.floor(F.col("t") / 50))
    got = running_totals(df, ["g"], ["cell"], ["t", "i"], {"upto": F.col("n"), "rank": F.lit(1)}).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [n for g, t, i, n in rows if g == r.g and (t, i) <= (r.t, r.i)]
        assert (r.upto, r.rank) == (sum(before), len(before))
        assert r.upto_all == sum(n for g, *_, n in rows if g == r.g)


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 10 + [("c",)], "k string")
    assert {r.k: r.splits for r in hot_keys(df, ["k"], 9).collect()} == {"a": 3, "b": 2}


def test_row_numbers_at_one_instant(spark):
    random.seed(2)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), random.choice([0, 0, 0, 5]), i * 7919 % 4001) for i in range(4001)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(6)
    want, last = {}, {}
    for g, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        last[g] = last.get(g, 0) + 1
        want[i] = last[g]
    for crowded in (10, 100_000):
        got = row_numbers(df, ["g"], "t", ["t", "i"], "n", crowded)
        assert got.columns == ["g", "t", "i", "n"] and {r.i: r.n for r in got.collect()} == want
    assert {r.i: r.n for r in numbered(df, ["g"], ["t", "i"], "n").collect()} == want


def test_newest_correlations_makes_few_pairs(spark):
    """The newest pairs of all, from a few hundred of 40,000; repeated ids, ties, and rows without a time."""
    random.seed(11)
    sides = []
    for side in "lm":
        rows = [(f"{side}{i}", random.randint(0, 90), None, None) for i in range(200)]
        rows += [(f"{side}7", 95, None, None), (None, 99, None, None), (f"{side}8", 9000, None, None)]
        sides.append(events(spark, *rows).unionByName(spark.createDataFrame([(f"{side}x", None, None, None)], SCHEMA)))
    left, right = sides
    pairs = J.find_correlations(left, right, now(), min_confidence=0.0).drop("detected_at")
    at = [df.select(F.col("id").alias(f"{n}_event_id"), F.col("detected_at").alias(c)) for df, n, c in zip(sides, ("log", "metric"), "ab")]
    whole = pairs.join(at[0], "log_event_id").join(at[1], "metric_event_id")
    whole = whole.select("id", "log_event_id", "metric_event_id", F.greatest("a", "b").alias("detected_at"))
    for limit in (1, 30, 100_000):
        found = J.newest_correlations(left, right, now(), limit).cache()
        order = [F.desc("detected_at"), "id"]
        assert found.orderBy(*order).limit(limit).collect() == whole.orderBy(*order).limit(limit).collect()
        assert limit == 100_000 or found.count() < 20_000


def test_crowded_buckets_repeat_rows_a_bounded_number_of_times(spark):
    """Parts of a row would repeat each row for all of the other side."""
    left, right = spark.range(600).selectExpr("id % 10 as a"), spark.range(600).selectExpr("id % 10 as b")
    sides = dealt(left, right, "a", "b", 10, 1)
    assert [df.count() for df in sides] == [600 * (16 + 2), 600 * 16]
    assert interval_join(left, right, "a", "b", 10, 1).count() == 360_000


def test_the_pairs_of_a_crowded_bucket_are_shared_out(spark):
    left = spark.range(6000, numPartitions=1).select(F.lit(100).cast("long").alias("a"), "id")
    right = left.select(F.col("a").alias("b"), F.col("id").alias("other"))
    pairs = interval_join(left, right, "a", "b", 300)
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == 6000 * 6000
    assert len(tasks) > 1 and max(t.n for t in tasks) < 6000 * 6000 * 0.9


def test_the_pairs_of_two_tables_are_shared_out_by_the_stream_join(spark):
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "id div 100 * 300 + 150 as seconds")
    side = rows.selectExpr("cast(id as string) id", "timestamp_seconds(seconds) detected_at", "'a' source", "'high' severity")
    pairs = stream_correlations(side, side, window_seconds=300, min_confidence=0.0)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # dealt out once
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == 100 * 100 * (40 + 2 * 39)
    assert len(tasks) > 1 and max(t.n for t in tasks) < 100 * 100 * (40 + 2 * 39) * 0.9


def test_the_parts_of_a_crowded_bucket_follow_each_other_in_time(spark):
    """Rows bunched at the start of the bucket, and 3,000 of 9,000 at one instant."""
    times = spark.range(6000).selectExpr("id * id div 400 as a").unionByName(spark.range(3000).selectExpr("50000L as a"))
    times = times.withColumn("id", F.monotonically_increasing_id())
    for side in dealt(times, times.withColumnsRenamed({"a": "b", "id": "other"}), "a", "b", 100_000, 1000):
        at, own, other = ("a", "left", "right") if "a" in side.columns else ("b", "right", "left")
        found = side.filter(f"__bucket = 0 and __{other}_part = 0").groupBy(f"__{own}_part").agg(
            F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")
        )
        parts = sorted((p.first, p.last, p.n) for p in found.select("first", "last", "n").collect())
        assert len(parts) == 9 and sum(n for *_, n in parts) == 9000
        assert max(n for *_, n in parts) < 1300
        assert all(b[0] >= a[1] - 100_000 / 256 for a, b in zip(parts, parts[1:]))


def test_pairs_come_in_runs_of_one_left_row_in_order_of_time(spark):
    rows = spark.range(900).selectExpr("id", "id * 7919 % 300 as a").repartition(7, "id")
    right = rows.withColumnsRenamed({"a": "b", "id": "other"}).repartition(5, "other")
    pairs = interval_join(rows, right, "a", "b", 300, 100).withColumn("place", F.monotonically_increasing_id())
    found = [(r.id, r.b) for r in pairs.orderBy("place").select("id", "b").collect()]
    assert len(found) == 900 * 900
    runs = sum(a[0] != b[0] for a, b in zip(found, found[1:])) + 1
    assert runs <= 900 * 9  # a run for each part of the other side
    assert sum(a[1] > b[1] for a, b in zip(found, found[1:])) < runs


def test_pairs_of_anomalies_that_share_their_instants_take_little_room(spark, tmp_path):
    """3,998,000 pairs of 40 instants; 10.9 MB when rows were dealt by their hash and joined as they came."""
    at = START + timedelta(seconds=1000)
    rows = spark.range(2000).selectExpr("cast(id as string) id", f"timestamp_seconds({int(at.timestamp())} - id % 40 * 7) detected_at")
    rows = rows.selectExpr("*", "concat('svc-', id % 3) source", "elt(1 + id % 4, 'low', 'medium', 'high', 'critical') severity")
    found = J.correlation_cycle(rows.repartition(8, "id"), at, min_confidence=0.0)
    found.drop("id").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2000 * 1999
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 6_000_000


def test_equal_rows_at_one_instant_are_dealt_to_several_parts(spark):
    rows = spark.range(0, 8000, 1, 40).selectExpr("50L as a", "'x' as id")
    left, _ = dealt(rows, rows.withColumnsRenamed({"a": "b", "id": "other"}), "a", "b", 100, 1000)
    parts = left.filter("__bucket = 0 and __right_part = 0").groupBy("__left_part").count().collect()
    assert sum(p["count"] for p in parts) == 8000 and max(p["count"] for p in parts) <= 4000
