"""As-of joins against brute force: many ranges, a key with most rows, nulls and ties."""

import random

import pytest

from paperloom.operators import asof


def brute(left, right):
    out = []
    for row in left:
        near = [r for r in right if r[0] == row[0] and r[1] is not None and row[1] is not None and r[1] <= row[1]]
        out.append((*row, *(max(near, key=lambda r: (r[1], r[2])) if near else (None, None, None))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_nearest_before_equals_brute_force(spark, tmp_path, parts):
    rng = random.Random(parts)
    keys = ["hot"] * 8 + ["a", "b", "c", None]
    times = [None, *range(120)]
    left = [(rng.choice(keys), rng.choice(times), k) for k in range(500)]
    right = [(rng.choice(keys), rng.choice(times), k) for k in range(200)] + [("hot", 3, -1), ("only right", 1, 1)]
    left.append(("only left", 5, 9))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, (some, others) in enumerate(((left, right), (left[:1], right), (left, right[:1]), (left, []), ([], right))):
            a, b = (spark.createDataFrame(x, "key string, at long, id long") for x in (some, others))
            got = asof.nearest_before(a, b, ["key"], "at", ["id"], str(tmp_path / f"out{n}"))
            assert got.columns == ["key", "at", "id", "right_key", "right_at", "right_id"]
            assert sorted(map(repr, map(tuple, got.collect()))) == brute(some, others)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_small_batches_carry_the_last_row_along(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rng = random.Random(1)
        left = [(rng.choice("ab"), rng.randrange(40), k) for k in range(60)]
        right = [(rng.choice("ab"), rng.randrange(40), k) for k in range(12)]
        a, b = (spark.createDataFrame(x, "key string, at long, id long") for x in (left, right))
        assert sorted(map(repr, map(tuple, asof.nearest_before(a, b, ["key"], "at", ["id"], str(tmp_path / "out")).collect()))) == brute(left, right)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
