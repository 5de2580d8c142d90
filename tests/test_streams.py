"""Late and early arrivals, and checks that come out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import signals
from marketloom.streaming import intraday, state
from marketloom.streaming.admission import HELD, KEPT, LATE, UNDATED, Admission, run_admitted_stream, with_arrival

NOON = dt.datetime(2024, 3, 1, 12)
ARRIVAL = "event_id int, published_at timestamp, arrived_at timestamp"
CHECKS = "asset_id int, ticker string, checked_at timestamp, signal string, confidence double"


def at(hours):
    return NOON + dt.timedelta(hours=hours)


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_every_arrival_is_accounted_for(spark, tmp_path):
    schema = spark.createDataFrame([], ARRIVAL).schema
    side = Admission(spark, str(tmp_path / "side"), schema)
    inbox, ck, given = str(tmp_path / "in"), str(tmp_path / "ck"), []
    rounds = [[(1, at(-1), at(0)), (2, at(-4), at(0)), (3, at(900), at(0)), (4, None, at(0)), (5, at(2), at(0))],
              [(6, at(0), at(3)), (7, at(-0.5), at(3)), (1, at(-1), at(3))],
              [(8, at(4), None)]]
    for rows in rounds:
        spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(inbox)
        stream = intraday.headline_stream(spark, inbox, schema)
        run_admitted_stream(stream, side, ck, lambda rows, n: given.append(ids(rows)), available_now=True).awaitTermination()
    # 5 is held at noon and let in three hours later; 3 still waits and has kept nobody out
    assert given == [[1], [5, 6], []]
    assert ids(side.rows(LATE)) == [1, 2, 7] and ids(side.rows(UNDATED)) == [4]
    kept, held = ids(side.rows(KEPT)), ids(side.rows(HELD))
    assert sorted(kept + held) == [1, 3, 5, 6, 8]
    total = side.counts().agg(F.sum("arrived"), F.sum("kept"), F.sum("late"), F.sum("undated")).first()
    assert total[0] == 9 == total[1] + total[2] + total[3] + len(held)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    schema = spark.createDataFrame([], ARRIVAL).schema
    side = Admission(spark, str(tmp_path / "side"), schema)
    batch = spark.createDataFrame([(1, at(0), at(0)), (2, at(9), at(0))], ARRIVAL)
    side.admit(batch, 0)
    later = spark.createDataFrame([(3, at(9), at(10))], ARRIVAL)

    def fail(rows, number):
        raise OSError("store is away")

    with pytest.raises(OSError):
        side.admit(later, 1, fail)
    assert side.counts().count() == 1 and ids(side.rows(HELD)) == [2]
    for _ in range(2):
        side.admit(later, 1)
    assert ids(side.rows(KEPT)) == [1, 2, 3] and ids(side.rows(HELD)) == []
    side.admit(spark.createDataFrame([], ARRIVAL), 2)
    assert side.counts().agg(F.sum("arrived"), F.sum("kept")).first()[:] == (3, 3)


def test_arrival_is_the_time_of_the_file(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, at(0))], "event_id int, published_at timestamp").write.parquet(path)
    came = with_arrival(spark.read.parquet(path)).first().arrived_at
    assert abs((dt.datetime.now() - came).total_seconds()) < 86_400


def run_checks(spark, tmp_path, rounds, **options):
    inbox, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in rounds:
        df = spark.createDataFrame(rows, CHECKS)
        df.coalesce(1).write.mode("append").parquet(inbox)
        with state.typed_state(spark):
            stream = state.ordered_signal_changes(intraday.headline_stream(spark, inbox, df.schema), **options)
            q = intraday.to_files(stream, out, ck)
        q.awaitTermination()
    return spark.read.schema(state.CHANGES).parquet(out)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_shuffled_checks_give_the_batch_result(spark, tmp_path):
    before = spark.conf.get(state.STORE, None)
    rng = random.Random(3)
    rows = [(a, f"T{a}", day(d), rng.choice(["UP", "DOWN"]), round(rng.random(), 3)) for a in (1, 2, 3) for d in range(12)]
    mixed = sorted(rows, key=lambda r: (r[2] + dt.timedelta(days=rng.uniform(0, 4)), rng.random()))
    # the clock row comes with checks of assets and must leave their keys alone
    clock = [(None, None, day(40), None, None)]
    got = run_checks(spark, tmp_path, [mixed[:13] + mixed[:2], mixed[13:24], clock + mixed[24:]], delay="5 days")
    want = signals.flips(spark.createDataFrame(rows, CHECKS), "checked_at").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.conf.get(state.STORE, None) == before


def test_idle_assets_are_forgotten_and_late_checks_left_out(spark, tmp_path):
    rounds = [[(1, "A", day(0), "UP", .6), (1, "A", day(1), "UP", .6), (2, "B", day(0), "UP", None), (1, "A", day(1), None, .9)],
              [(2, "B", day(20), "DOWN", .6), (1, "A", day(60), "UP", .6)],
              [(1, "A", day(2), "DOWN", .6), (None, None, day(90), None, None)]]
    got = sorted((r.ticker, (r.checked_at - day(0)).days, r.signal, r.previous_signal, r.changed)
                 for r in run_checks(spark, tmp_path, rounds, delay="1 day", idle_days=30).collect())
    assert got == [("A", 0, "UP", None, False), ("A", 60, "UP", None, False), ("B", 0, "UP", None, False), ("B", 20, "DOWN", "UP", True)]
