import random

import numpy as np

from chronolith.operators.intervals import disjoint_lists, merge_lists, periods_and_gaps

SCHEMA = "e string, f string, start long, end long, slice long, starts string"


def brute(rows):
    out = set()
    for key in {r[:2] for r in rows}:
        iv = sorted((a, 1 << 62 if b is None else b) for e, f, a, b, *_ in rows if (e, f) == key and a is not None and (b is None or b > a))
        merged = []
        for a, b in iv:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, -1 if b == 1 << 62 else b) for a, b in merged}
        out |= {(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **options):
    got = [tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["e", "f"], **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force_however_slices_are_cut(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        a = r.choice([r.randrange(1000), r.randrange(100) * 10, None])
        length = r.choice([0, 1, 3, 10, 10, 50, 400, -5])
        rows.append((r.choice(["hot", "hot", "x", "y", None]), r.choice(["f", None]), a, None if r.random() < 0.01 or a is None else a + length, 1, "clash"))
    want = brute(rows)
    for dense in (2, 40, 10**9):
        assert run(spark, rows, dense=dense) == want


def test_a_dense_slice_is_cut_and_no_list_is_long(spark):
    rows = [("hot", "f", 10 * i, 10 * i + 5, 0, "") for i in range(-300, 700)] + [("hot", "f", 1 << 40, None, 0, ""), ("x", "f", 3, 4, 0, "")]
    lists = disjoint_lists(spark.createDataFrame(rows, SCHEMA), ["e", "f"], dense=50).collect()
    assert max(len(r["starts"]) for r in lists) <= 50
    assert sum(len(r["starts"]) for r in lists) == len(rows)
    assert run(spark, rows, dense=50) == brute(rows)


def test_touching_nested_open_repeated(spark):
    rows = [("a", "f", 0, 10, 0, ""), ("a", "f", 10, 20, 0, ""), ("a", "f", 2, 5, 0, ""), ("a", "f", 30, None, 0, ""), ("a", "f", 40, 50, 0, ""), ("a", "f", 0, 10, 0, "")]
    assert run(spark, rows, dense=1) == {("a", "f", "period", 0, 20), ("a", "f", "gap", 20, 30), ("a", "f", "period", 30, -1)}


def test_nothing(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "f", 5, 5, 0, ""), ("a", "f", None, 5, 0, "")]) == set()


def test_merge_lists_is_associative():
    r = random.Random(4)

    def some():
        points = sorted(r.sample(range(300), 20))
        return np.array(points[::2]), np.array(points[1::2])

    for _ in range(50):
        a, b, c = some(), some(), some()
        x, y = merge_lists(merge_lists(a, b), c), merge_lists(a, merge_lists(b, c))
        assert all((p == q).all() for p, q in zip(x, y))
        covered = {t for s, e in (a, b, c) for i, j in zip(s, e) for t in range(i, j)}
        assert {t for i, j in zip(*x) for t in range(i, j)} == covered
        assert (x[0][1:] > x[1][:-1]).all()
