import random
from collections import Counter

import pytest

from chronolith.llm.packing import Plan, pack


def histogram(seed, capacity, n=400):
    r = random.Random(seed)
    draw = [lambda: r.randrange(1, capacity + 1), lambda: r.choice([capacity, capacity // 2, capacity // 3, capacity // 3 + 1, 1, 7 % capacity + 1]), lambda: min(capacity, 1 + int(r.expovariate(4 / capacity)))]
    return Counter(r.choice(draw)() for _ in range(n))


def layout(plan, hist):
    """bin -> sizes, from the runs; every item exactly once."""
    runs = {}
    for size, lo, each, first in plan.runs:
        runs.setdefault(size, []).append((lo, each, first))
    bins, seen = {}, Counter()
    for size, rs in runs.items():
        rs.sort()
        for (lo, each, first), nxt in zip(rs, [r[0] for r in rs[1:]] + [hist[size]]):
            for rank in range(lo, nxt):
                bins.setdefault(first + (rank - lo) // each, []).append(size)
                seen[size] += 1
    assert seen == Counter({s: n for s, n in hist.items() if n})
    return bins


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("capacity", [1, 2, 3, 10, 97, 512])
def test_plan_places_all_and_overfills_none(seed, capacity):
    hist = histogram(seed, capacity)
    plan = Plan(capacity, dict(hist))
    bins = layout(plan, hist)
    assert all(sum(b) <= capacity for b in bins.values())
    assert sorted(bins) == list(range(plan.bins))
    volume = -(-sum(s * n for s, n in hist.items()) // capacity)
    # what exceeds a half needs a bin of its own
    assert max(volume, sum(n for s, n in hist.items() if 2 * s > capacity)) <= plan.bins <= first_fit_decreasing(hist, capacity)


def first_fit_decreasing(hist, capacity):
    gaps = []
    for s in sorted(hist.elements(), reverse=True):
        for i, g in enumerate(gaps):
            if g >= s:
                gaps[i] -= s
                break
        else:
            gaps.append(capacity - s)
    return len(gaps) + 1


def test_large_items_are_matched_as_well_as_possible():
    for seed in range(200):
        r = random.Random(seed)
        capacity = 30
        sizes = [r.randrange(11, 31) for _ in range(9)]
        best = {}

        def fewest(left):
            if not left:
                return 0
            if left not in best:
                a, rest = left[0], left[1:]
                best[left] = 1 + min([fewest(rest)] + [fewest(rest[:i] + rest[i + 1 :]) for i, b in enumerate(rest) if a + b <= capacity])
            return best[left]

        assert Plan(capacity, dict(Counter(sizes))).bins == fewest(tuple(sorted(sizes)))


def check(rows, sizes, capacities):
    by_container = {}
    for r in rows:
        by_container.setdefault(r["container_id"], []).append(r)
    assert set(by_container) == set(capacities)
    for name, rs in by_container.items():
        cap, used, docs = capacities[name], Counter(), {}
        for r in rs:
            used[r["bin_no"]] += r["n_tokens"]
            docs.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        assert max(used.values()) <= cap
        assert set(docs) == {d for d, _ in sizes}
        for d, n in sizes:
            ps = sorted(docs[d])
            assert [p[0] for p in ps] == list(range(len(ps))) and len(ps) == max(1, -(-n // cap))
            at = 0
            for _, start, size in ps:
                assert start == at
                at += size
            assert at == n


@pytest.mark.parametrize("rank", [3, 1_000_000])
def test_documents_over_spark(spark, rank):
    r = random.Random(1)
    sizes = [(i, r.choice([0, 5, 5, 5, 64, r.randrange(300), r.randrange(40)])) for i in range(500)]
    caps = {"a": 64, "b": 10}
    containers = spark.createDataFrame([(k, v, "x") for k, v in caps.items()], "container_id string, capacity_tokens int, doc_id string")
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(5)
    check(pack(df, containers, rows_a_rank=rank).collect(), sizes, caps)


def test_edges(spark):
    containers = spark.createDataFrame([("a", 4)], "container_id string, capacity_tokens int")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, n_tokens long")
    assert pack(df([]), containers).count() == 0
    assert [(r["bin_no"], r["n_tokens"]) for r in pack(df([(1, 0)]), containers).collect()] == [(0, 0)]
    assert sorted((r["bin_no"], r["n_tokens"]) for r in pack(df([(1, 2), (1, 2)]), containers).collect()) == [(0, 2), (0, 2)]
    with pytest.raises(ValueError):
        pack(df([(1, 2)]), spark.createDataFrame([("a", 0)], "container_id string, capacity_tokens int"))


def test_a_container_has_one_capacity(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long")
    boxes = lambda *rows: spark.createDataFrame(list(rows), "container_id string, capacity_tokens int")
    with pytest.raises(ValueError, match="one capacity"):
        pack(sizes, boxes(("a", 4), ("a", 8)))
    assert pack(sizes, boxes(("a", 8), ("a", 8))).count() == 1
