import random
from collections import Counter

import pytest

from citeloom.operators import keyed


def brute_percentile(values, p):
    values = sorted(values)
    return values[max(1, -(-int(p * 100) * len(values) // 100)) - 1]


def test_profile_counts_nulls_duplicates_and_ties(spark):
    data = [(1, 10), (1, 10), (1, 20), (1, 20), (1, None), (2, None), (None, 5), (None, 5)]
    df = spark.createDataFrame(data, "key long, value long")
    got = {r["key"]: (r["n_rows"], r["n_distinct"], r["mode_value"], r["mode_rows"]) for r in keyed.profile(keyed.compress(df, "key", "value")).collect()}
    assert got == {1: (5, 2, 10, 2), 2: (1, 0, None, 0), None: (2, 1, 5, 2)}


def test_both_sides_agree_with_one_side(spark):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([7, 8, None])) for _ in range(300)]
    df = spark.createDataFrame(data, "user_id long, item_id long").withColumnRenamed("user_id", "u").withColumnRenamed("item_id", "i")
    both = keyed.profile(keyed.compress_both(df, "u", "i"), ["key_field", "key"]).collect()
    for field, at in (("u", 0), ("i", 1)):
        want = Counter(x[at] for x in data)
        assert {r["key"]: r["n_rows"] for r in both if r["key_field"] == field} == dict(want)


@pytest.mark.parametrize("buckets", [2, 64])
def test_percentiles_are_exact_on_a_hot_key(spark, buckets):
    rng = random.Random(1)
    data = [(1 if rng.random() < 0.5 else rng.randrange(2, 9), rng.choice([rng.randrange(-50, 1000), 3])) for _ in range(3000)] + [(9, None), (None, 4)]
    df = spark.createDataFrame(data, "key long, value long")
    got = {r["key"]: (r["a"], r["b"]) for r in keyed.percentiles(keyed.compress(df, "key", "value"), {"a": 0.5, "b": 0.9}, buckets).collect()}
    by = {}
    for k, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got == {k: (brute_percentile(v, 0.5), brute_percentile(v, 0.9)) for k, v in by.items()}


@pytest.mark.parametrize("range_rows", [1, 7, 100])
def test_large_ranges_are_cut_again_until_none_is(spark, range_rows):
    rng = random.Random(2)
    data = [(1, rng.randrange(100_000)) for _ in range(2000)] + [(k, rng.randrange(50)) for k in (2, 3, None) for _ in range(40)]
    got = keyed.percentiles(keyed.compress(spark.createDataFrame(data, "key long, value long"), "key", "value"), {"a": 0.01, "b": 0.5, "c": 0.99}, 4, range_rows)
    by = {}
    for k, v in data:
        by.setdefault(k, []).append(v)
    assert {r["key"]: (r["a"], r["b"], r["c"]) for r in got.collect()} == {k: tuple(brute_percentile(v, p) for p in (0.01, 0.5, 0.99)) for k, v in by.items()}


def test_heavy_keys_in_whole_numbers(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(k, 1) for k in range(2, 299)], "key long, value long")
    profiles = keyed.profile(keyed.compress(df, "key", "value"))
    assert [r["key"] for r in keyed.heavy_keys(profiles, 300).collect()] == [1]
    assert keyed.heavy_keys(profiles, 301).count() == 0


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "key long, value long, weight long")
    assert keyed.profile(keyed.compress(df, "key", "value")).count() == 0
    assert keyed.percentiles(keyed.compress(df, "key", "value"), {"p": 0.5}).count() == 0
    df = spark.createDataFrame([(1, 2, 3, 4)], "key long, value long, weight long, bucket long")
    assert keyed.percentiles(keyed.compress(df, "key", "value"), {"p": 0.5}).collect()[0]["p"] == 2
