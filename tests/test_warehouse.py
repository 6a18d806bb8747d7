"""Every warehouse query against its SQL in DuckDB, and the streaming form against the batch."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators.relational import as_of_latest, visits
from millrace.plans import warehouse
from millrace.sources import read_table, write_partitioned
from millrace.streaming import follow_visits, hourly_counts, into_batches, run_once, user_visits

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 2)
    return v.isoformat() if isinstance(v, dt.datetime) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(warehouse.QUERIES))
def test_query_gives_what_sql_gives(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = warehouse.QUERIES[name](spark, FOLDER)
    want = db.execute(warehouse.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    found = want.fetchall()
    assert found and rows(got.columns, got.collect()) == rows(names, found)


@pytest.fixture(scope="module")
def hot_events(spark):
    """(user_id, event_id, ts, value, kind): one user has a third of all events, and null keys and ties are there."""
    rng = random.Random(4)
    start = dt.datetime(2024, 3, 30, 22)
    out = []
    for k in range(1500):
        user = 1 if k % 3 == 0 else rng.choice([2, 3, 4, 5, 6, 7, None])
        out.append((user, k, start + dt.timedelta(seconds=rng.choice([0, 1800, 3600, 5400]) + 60 * rng.randint(0, 4000 if user == 1 else 20_000)), float(rng.randint(1, 500)), rng.choice(["click", "purchase", "view"])))
    return out, spark.createDataFrame(out, "user_id long, event_id long, ts timestamp_ntz, value double, kind string")


@pytest.mark.parametrize("every", ["minute", "hour", "month"])
def test_visits_of_hot_users_are_split_and_stitched(hot_events, every):
    events, df = hot_events
    want, gap = [], dt.timedelta(minutes=30)
    for user in {e[0] for e in events}:
        mine = sorted((e[2], e[3]) for e in events if e[0] == user)
        cuts = [0, *(k for k in range(1, len(mine)) if mine[k][0] - mine[k - 1][0] > gap), len(mine)]
        want += [(user, n + 1, mine[a][0], mine[b - 1][0], b - a, sum(v for _, v in mine[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = visits(df, "user_id", "ts", "30 minutes", F.count("*").alias("n"), F.sum("value").alias("value"), every=every)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("every", ["minute", "hour", "month"])
def test_last_clicks_are_carried_over_periods(hot_events, every):
    events, df = hot_events
    clicks = [(e[0], e[2], e[1]) for e in events if e[4] == "click"]
    want = [(u, k, t, max(((s, c) for v, s, c in clicks if u is not None and v == u and s <= t), default=(None, None))[1]) for u, k, t, _, kind in events if kind == "purchase"]
    left = df.where("kind = 'purchase'").select("user_id", "event_id", "ts")
    right = df.where("kind = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    got = as_of_latest(left, right, "user_id", "ts", "click_ts", "click_id", every)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({x[3] for x in want}) > 100


def test_filters_and_columns_reach_the_scan(spark):
    plan = warehouse.pricing_summary(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_stream_gives_the_closed_hours_of_the_batch(spark, tmp_path):
    events = read_table(spark, FOLDER, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    run_once(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = events.agg(F.max("ts").alias("t")).first()["t"] - dt.timedelta(hours=2)
    batch = hourly_counts(events).where(F.col("hour") <= F.lit(closed))
    stream = spark.read.parquet(str(tmp_path / "out")).where(F.col("hour") <= F.lit(closed))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_visits_of_a_stream_are_those_of_the_batch_whatever_repeats(spark, tmp_path):
    events = read_table(spark, FOLDER, "events").where("user_id <= 200")
    cut = dt.timedelta(hours=1)
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    half = events.agg(F.expr("percentile_approx(cast(ts as timestamp), 0.5)").cast("timestamp_ntz").alias("t")).first()["t"]
    first, second = events.where(F.col("ts") < F.lit(half)), events.where(F.col("ts") >= F.lit(half))
    repeats = first.where(F.col("ts") >= F.lit(half - dt.timedelta(days=3)))
    where = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    # the state of a first run is taken up by the second, which also meets the first's rows again
    for part in (first, second.unionByName(repeats).unionByName(second.where("event_id % 3 = 0"))):
        part.coalesce(1).write.mode("append").parquet(where["in"])
        follow_visits(spark, where["in"], events.schema, where["out"], where["state"])
    closed = F.col("ended") <= F.lit(last - 2 * cut)
    names = ["user_id", "began", "ended", "n", "value"]
    whole = visits(events.select("user_id", "ts", "value"), "user_id", "ts", "30 minutes", F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("value"))
    want = whole.withColumn("value", F.col("value").cast("double")).where(closed).select(names).collect()
    got = spark.read.parquet(where["out"]).where(closed).select(names).collect()
    assert rows(names, got) == rows(names, want) and len(want) > 100
    batch = user_visits(events.unionByName(repeats)).where(closed).select(names).collect()
    assert rows(names, batch) == rows(names, want)


def test_events_a_gap_apart_are_one_visit_in_all_forms(spark):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    events = spark.createDataFrame([(1, at(0), 7, 1.0), (2, at(30), 7, 2.0), (2, at(30), 7, 2.0), (3, at(0), None, 1.0), (4, None, 7, 1.0), (5, at(0), 8, None), (6, at(30, 1), 8, 3.0)], "event_id long, ts timestamp_ntz, user_id long, value double")
    got = user_visits(events).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(7, at(0), at(30), 2, 3.0), (None, at(0), at(0), 1, 1.0), (8, at(0), at(0), 1, None), (8, at(30, 1), at(30, 1), 1, 3.0)], key=repr)
    assert user_visits(events.where("false")).count() == 0


def test_a_batch_that_is_written_again_leaves_no_row_twice(spark, tmp_path):
    write = into_batches(str(tmp_path))
    for batch, n in ((0, 3), (1, 2), (1, 2)):
        write(spark.range(n), batch)
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_partitioned_write_keeps_all_rows(spark, tmp_path):
    nations = read_table(spark, FOLDER, "nation")
    write_partitioned(nations, str(tmp_path / "n"), "n_regionkey")
    assert spark.read.parquet(str(tmp_path / "n")).count() == nations.count()
