import random
from decimal import Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.operators.intervals import _canonical, continuous, dyadic_blocks, maximal_blocks, row_intervals

SCHEMA = "key struct<mpd_id:string,period_id:string,as_id:int>, start decimal(38,0), end decimal(38,0)"
S = "mpd_id string, period_id string, as_id int, timescale bigint, snap int, ord int, t decimal(20,0), n decimal(20,0), d decimal(20,0), r bigint, k bigint, captured_at timestamp, key string"


def brute(intervals):
    out, by = set(), {}
    for key, a, b in intervals:
        if a is not None and b is not None and a < b:
            by.setdefault(key, []).append((a, b))
    for key, xs in by.items():
        xs.sort()
        s, e = xs[0]
        for a, b in xs[1:]:
            if a > e:
                out |= {(key, "period", s, e), (key, "gap", e, a)}
                s, e = a, b
            e = max(e, b)
        out.add((key, "period", s, e))
    return out


@given(st.integers(0, 2**66), st.integers(1, 2**66))
@settings(max_examples=300, deadline=None)
def test_blocks_are_canonical(start, length):
    blocks = list(dyadic_blocks(start, start + length))
    at = start
    for s, level in blocks:
        assert s == at and s % (1 << level) == 0
        at += 1 << level
    assert at == start + length
    for (a, i), (b, j) in zip(blocks, blocks[1:]):
        assert not (i == j and a ^ b == 1 << i), "siblings must have been one block"


@given(st.lists(st.tuples(st.integers(0, 2**61), st.integers(1, 2**60)), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_blocks_of_many_are_those_of_each(pairs):
    row, start, level = _canonical(np.array([a for a, _ in pairs]), np.array([a + n for a, n in pairs]))
    got = sorted(zip(row.tolist(), start.tolist(), level.tolist()))
    assert got == sorted((i, s, v) for i, (a, n) in enumerate(pairs) for s, v in dyadic_blocks(a, a + n))


def test_maximal_blocks(spark):
    """Covered and repeated blocks are gone and no two siblings below a cell's size are left."""
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(1, 60)) for a in (rng.randrange(3000) for _ in range(300))] + [(2**24 - 3, 2**24 + 9), (2**30, 2**30 + 3 * 2**24)]
    df = spark.createDataFrame([(("a", None, 1), Decimal(a), Decimal(b)) for a, b in spans], SCHEMA)
    blocks = {((r.top << 84) + (r.cell << 24) + r.off, r.level) for r in maximal_blocks(df).collect()}
    covered = {x for a, b in spans if b < 2**25 for x in range(a, b)}
    small = [(s, v) for s, v in blocks if s < 2**25]
    assert sum(1 << v for _, v in small) == len(covered) and {x for s, v in small for x in range(s, s + (1 << v))} == covered
    assert not [1 for s, v in blocks if v < 24 and (s ^ (1 << v), v) in blocks]


def test_random_intervals(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        key = (rng.choice(["a", "b", None]), rng.choice(["p", None]), rng.choice([1, None]))
        scale = rng.choice([50, 2**25, 2**40, 2**64])
        a = rng.randrange(scale)
        rows.append((key, a, a + rng.choice([0, 1, 3, scale // 40 + 1, scale // 3])))
    rows += [(("edge", "p", 1), 2**24 - 5, 2**24), (("edge", "p", 1), 2**24, 2**24 + 5), (("edge", "p", 1), 2**64 - 1, 2**64 + 7), (("edge", "p", 1), None, 5)]
    rows += rows[:50]
    df = spark.createDataFrame([(k, None if a is None else Decimal(a), Decimal(b)) for k, a, b in rows], SCHEMA)
    got = {(tuple(r.key), r.kind, int(r.start), int(r.end)) for r in continuous(df).collect()}
    assert got == brute(rows)


def test_rows_of_timelines(spark):
    one = lambda snap, ord, t, d, r: ("m", "p", 1, 1, snap, ord, None if t is None else Decimal(t), None, None if d is None else Decimal(d), r, None, None, "x")  # noqa: E731, A002
    rows = [
        one(1, 1, 0, 10, None), one(1, 2, None, 5, 1), one(1, 3, None, None, None), one(1, 4, None, 5, 0),  # 0..25
        one(1, 5, 100, 10, -1), one(1, 6, 150, 10, 0),  # 100..160
        one(2, 1, None, 7, 0), one(2, 2, 30, 0, 4), one(2, 3, None, 2, 0),  # 0..7, 30..32
        one(3, 2, 40, 10, -1),  # nothing after it
        one(3, 1, 40, 1, -5),
    ]
    got = {(r.snap, int(r.start), int(r.end)) for r in row_intervals(spark.createDataFrame(rows + rows[:3], S)).collect()}
    assert got == {(1, 0, 10), (1, 10, 20), (1, 20, 25), (1, 100, 150), (1, 150, 160), (2, 0, 7), (2, 30, 32)}
    periods = sorted((r.kind, int(r.start), int(r.end)) for r in continuous(row_intervals(spark.createDataFrame(rows, S))).collect())
    assert periods == [("gap", 25, 30), ("gap", 32, 100), ("period", 0, 25), ("period", 30, 32), ("period", 100, 160)]


def test_empty(spark):
    assert continuous(row_intervals(spark.createDataFrame([], S))).count() == 0


def test_negative_starts(spark):
    rows = [(("a", "p", 1), -5, 3), (("a", "p", 1), -(2**25) - 1, -(2**24)), (("a", "p", 1), 3, 4), (("b", "p", 1), -1, 1), (("b", "p", 1), -9, -2)]
    df = spark.createDataFrame([(k, Decimal(a), Decimal(b)) for k, a, b in rows], SCHEMA)
    assert {(tuple(r.key), r.kind, int(r.start), int(r.end)) for r in continuous(df).collect()} == brute(rows)


def test_rows_reach_the_blocks_unjoined(spark, tmp_path, monkeypatch):
    import sluice.operators.intervals as module

    given, whole = [], module.continuous
    monkeypatch.setattr(module, "continuous", lambda df: given.append(df) or whole(df))
    rows = [("m", "p", 1, 1, 1, k, Decimal(t), None, Decimal(d), 0, None, None, "x") for k, (t, d) in enumerate(((0, 10), (5, 2), (8, 10), (18, 2), (30, 1)))]
    spark.createDataFrame(rows, S).write.parquet(str(tmp_path / "segment_timeline_s.parquet"))
    got = sorted((r.kind, r.start_t, r.end_t) for r in module.p2_found(spark, str(tmp_path)).collect())
    assert got == [("gap", "20", "30"), ("period", "0", "20"), ("period", "30", "31")]
    assert sorted((int(r.start), int(r.end)) for r in given[0].collect()) == [(0, 10), (5, 7), (8, 18), (18, 20), (30, 31)]
