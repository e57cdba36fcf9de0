import random
from datetime import datetime, timedelta

import numpy as np

from citeloom.operators import references as R

REFS, PARENTS = "key long, at timestamp", "key long, added_at timestamp, removed_at timestamp"


def brute(refs, parents):
    out = set()
    for name, space, rows in refs:
        for key, at in rows:
            if key is None or at is None:
                continue
            mine = [p for p in parents[space] if p[0] == key]
            if any(a is not None and a <= at and (r is None or at < r) for _, a, r in mine):
                continue
            reason = "missing" if not mine else "deleted" if any(r is not None and r <= at for _, _, r in mine) else "late"
            out.add((name, at.strftime("%Y-%m"), key, reason))
    return sorted(out)


def run(spark, refs, parents):
    got = R.orphan_references([(n, s, spark.createDataFrame(x, REFS)) for n, s, x in refs], [spark.createDataFrame(p, PARENTS) for p in parents])
    return sorted(map(tuple, got.select("table_name", "load_month", "key", "reason").collect()))


def test_against_brute_force(spark):
    rng = random.Random(2)
    start = datetime(2023, 1, 1)
    day = lambda: start + timedelta(days=rng.randrange(0, 200), seconds=rng.choice([0, 0, rng.randrange(86400)]))
    parents = []
    for _ in range(2):
        rows = []
        for _ in range(150):
            a = day()
            rows.append((rng.choice([rng.randrange(40), rng.randrange(65500, 65560)]), rng.choice([a, a, a, None]), rng.choice([None, a + timedelta(days=rng.randrange(0, 90))])))
        parents.append(rows + rows[:10] + [(None, start, None)])
    refs = [(n, s, [(rng.choice([None, 3, 3, 3, rng.randrange(60), rng.randrange(65500, 65600)]), rng.choice([None, *[day()] * 9])) for _ in range(400)]) for n, s in (("x", 0), ("y", 0), ("z", 1))]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_boundaries_of_months_and_intervals(spark):
    t = datetime(2023, 3, 1)
    parents = [[(1, t, datetime(2023, 4, 1)), (1, datetime(2023, 4, 1), None), (2, t, t)]]
    refs = [("x", 0, [(1, t), (1, t - timedelta(microseconds=1)), (1, datetime(2023, 4, 1)), (2, t), (-5, t)])]
    assert run(spark, refs, parents) == brute(refs, parents) == [("x", "2023-02", 1, "late"), ("x", "2023-03", -5, "missing"), ("x", "2023-03", 2, "deleted")]


def test_empty_tables(spark):
    assert run(spark, [("x", 0, [])], [[]]) == []
    assert run(spark, [("x", 0, [(4, datetime(2023, 1, 2))])], [[]]) == [("x", "2023-01", 4, "missing")]
    assert run(spark, [("x", 0, [])], [[(4, datetime(2023, 1, 2), None)]]) == []


def test_containers_round_trip():
    for n in (0, 1, 5000):
        places = np.sort(np.random.default_rng(n).choice(R.RANGE, n, replace=False))
        assert np.flatnonzero(np.unpackbits(R.decode_bits(R.encode_places(places)))).tolist() == places.tolist()
    assert len(R.encode_places(np.arange(60_000))) == 8193


def test_number_keys(spark):
    df = spark.createDataFrame([("007",), (" 7",), ("7.0",), ("7.5",), ("x",), (None,), ("",), (" 7　",)], "t string")
    assert [r[0] for r in df.select(R.number_key("t")).collect()] == [7, 7, 7, None, None, None, None, 7]
