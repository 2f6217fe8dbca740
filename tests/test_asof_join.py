import random

from pyspark.sql import functions as F

from chronolith.operators.asof_join import GRAIN, LEVELS, attributes_as_known, cover, enclosing, hot_entities

VERSIONS = "version string, e string, valid_from long, valid_to long, known_at long, closed_known_at long, start string, level string"
EVENTS = "event_id long, e string, at long, by long, d0 string"
STEP = 1 << GRAIN


def brute(events, versions):
    out = {}
    for id_, e, at, by, _ in events:
        if at is None or by is None:
            continue
        ok = [(f, v) for v, ve, f, t, k, c, *_ in versions if ve == e and f is not None and f <= at and k is not None and k <= by and (t is None or t > at or c is None or c > by)]
        if ok:
            out[id_] = max(ok)[1]
    return out


def run(spark, events, versions):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    got = attributes_as_known(e, v, ["e"]).collect()
    assert len({r["event_id"] for r in got}) == len(got)
    return {r["event_id"]: r["version"] for r in got}


def random_case(seed, n_versions, n_events, entities):
    r = random.Random(seed)
    t = lambda: r.choice([r.randrange(STEP * 60), r.randrange(60) * STEP, r.randrange(STEP)])
    opt = lambda x: r.choice([None, x, x])
    versions = [(f"v{i}", r.choice(entities), r.choice([t(), t(), t(), None]), opt(t()), opt(t()), opt(t()), "", "") for i in range(n_versions)]
    events = [(i, r.choice(entities), r.choice([t(), t(), t(), t(), None]), r.choice([t(), STEP * 70, STEP * 70]), "") for i in range(n_events)]
    return events, versions


def test_matches_brute_force(spark):
    for seed in range(3):
        events, versions = random_case(seed, 120, 200, ["x", "y", "z"])
        assert run(spark, events, versions) == brute(events, versions)


def test_hot_entity_repeated_versions_and_ties(spark):
    events, versions = random_case(9, 150, 150, ["hot", "hot", "hot", "cold"])
    tied = [("w1", "hot", 5, None, 0, None, "", ""), ("w2", "hot", 5, None, 0, None, "", "")]
    assert run(spark, events, versions + versions[:40] + tied) == brute(events, versions + tied)


def test_pruned_nodes_of_hot_entities(spark):
    for seed in (11, 12):
        events, versions = random_case(seed, 200, 200, ["hot", "hot", "hot", "cold", None])
        # mostly open versions that become known in order, read long after
        versions += [(f"open{i}", "hot", i * STEP // 4, None, i * STEP // 4 + 5, None, "", "") for i in range(200)]
        events += [(1000 + i, "hot", i * STEP // 3, i * STEP // 3 + r, "") for i, r in enumerate([0, 3, 10, STEP, STEP * 9] * 30)]
        e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
        hot = hot_entities(v, ["e"], 60)
        assert len(hot) == 1
        got = {r["event_id"]: r["version"] for r in attributes_as_known(e, v, ["e"], hot).collect()}
        assert got == brute(events, versions)


def test_pruned_edge_nodes_hold_times_outside_the_tree(spark):
    far = 1 << 43
    versions = [("a", "x", -1000, None, 0, None, "", ""), ("b", "x", -100, None, 0, None, "", ""), ("c", "x", far + 100, None, 0, None, "", "")]
    events = [(1, "x", -500, far, ""), (2, "x", -50, far, ""), (3, "x", far, far, ""), (4, "x", far + 100, far, ""), (5, "x", -2000, far, "")]
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    hot = hot_entities(v, ["e"], 1)
    got = {r["event_id"]: r["version"] for r in attributes_as_known(e, v, ["e"], hot).collect()}
    assert len(hot) == 1 and got == brute(events, versions) == {1: "a", 2: "b", 3: "b", 4: "c"}


def test_edges_of_time(spark):
    versions = [("a", "x", 10, 20, 0, 0, "", ""), ("b", "x", 30, 30, 0, 0, "", ""), ("c", "x", -5, 5, 0, 0, "", "")]
    events = [(1, "x", 9, 99, ""), (2, "x", 10, 99, ""), (3, "x", 19, 99, ""), (4, "x", 20, 99, ""), (5, "x", 30, 99, ""), (6, "x", -5, 99, ""), (7, "x", 4, 99, ""), (8, "x", 5, 99, "")]
    assert run(spark, events, versions) == {2: "a", 3: "a", 6: "c", 7: "c"}


def test_empty_tables(spark):
    assert run(spark, [], [("a", "x", 10, 20, 0, 0, "", "")]) == {}
    assert run(spark, [(1, "x", 9, 99, "")], []) == {}


def test_cover_is_exact_and_short(spark):
    r = random.Random(5)
    rows = [(a, a + r.randrange(1, STEP * 4000)) for a in (r.randrange(STEP * 5000) for _ in range(60))]
    for a, b, nodes in spark.createDataFrame(rows, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("n")).collect():
        assert len(nodes) <= 2 * LEVELS
        grains = sorted(g for n in nodes for g in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert grains == list(range(a >> GRAIN, -(-b // STEP)))
    path = spark.createDataFrame([(STEP * 1000 + 7,)], "t long").select(enclosing(F.col("t")).alias("p")).first()["p"]
    assert [(n["level"], n["node"]) for n in path][:2] == [(0, 1000), (1, 500)]
