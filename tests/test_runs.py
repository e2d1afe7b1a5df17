"""Stop rules against a plain loop, with runs that cross many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import runs


def looped(rows, limit):
    seen, state = [], {}
    for key, at, bad in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        run = state.get(key, 0)
        if run == limit:
            continue
        state[key] = run + 1 if bad else 0
        seen.append((key, at, state[key] == limit))
    return seen


@pytest.mark.parametrize("share", [0.2, 0.85, 1.0])
def test_stop_equals_the_loop(spark, share):
    rng = random.Random(int(share * 100))
    rows = [("hot", i, rng.random() < share) for i in range(1500)]
    rows += [(rng.choice(["a", "b", None]), 10_000 + i, rng.random() < share) for i in range(300)]
    rows += [(f"k{i}", i, True) for i in range(200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, at long, bad boolean")
    for limit in (1, 5, 60, 2000):
        got = runs.until_stop(frame, ["key"], ["at"], F.col("bad"), limit, rows_per_range=37)
        found = [(r.key, r.at, r.stopped) for r in got.select("key", "at", "stopped").collect()]
        assert sorted(found, key=str) == sorted(looped(rows, limit), key=str)


def test_run_lengths_of_two_conditions(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    low, odd = F.col("id") < 400, F.when(F.col("id") > 9, F.col("id") % 2 == 1)
    got = runs.run_lengths(frame, ["k"], ["id"], [low, odd], ["low", "odd"], rows_per_range=20)
    state = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        a, b = state.get(r.k, (0, 0))
        a, b = a + 1 if r.id < 400 else 0, b + 1 if r.id > 9 and r.id % 2 else 0
        state[r.k] = (a, b)
        assert (r.low, r.odd) == (a, b)
    assert runs.until_stop(frame.where("false"), ["k"], ["id"], low, 3).count() == 0
