import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronolith.functions import classify as C, text as T
from chronolith.operators import fold as W

SAMPLES = ["Gate nine opens on RIVER_LEVEL", "", "   ", "é 漢字 x y " * 40, "a.b/c-d_e 123 4567 v1.2", "Pilots no longer moor here; it is deprecated", "no-break space　wide", "İstanbul KELVIN K", "..a.. --bb-- ccc"]


def column(spark, expr, samples=SAMPLES):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_golden_terms_and_ids(spark):
    t = F.col("t")
    assert column(spark, T.terms(t))[0] == ["gate", "nine", "opens", "river_level"]
    ids = [(("tenant", "project"), "1d95f4617dd24170"), (("ab", ""), "fdf42483ef9ca070"), (("é", "漢字"), "c49f516789c38bb2")]
    for parts, want in ids:
        assert column(spark, T.fnv1a64(*map(F.lit, parts)), ["x"]) == [want]
        assert column(spark, T.fnv1a64_expr(*map(F.lit, parts)), ["x"]) == [want]
        assert W.fnv(*parts) == want


def test_columns_agree_with_the_fold(spark):
    r = random.Random(1)
    samples = SAMPLES + ["".join(r.choices("aB9_./- é漢the \n", k=r.randrange(60))) for _ in range(300)]
    t = F.col("t")
    assert column(spark, T.terms(t), samples) == [W.terms(s) for s in samples]
    assert column(spark, T.top_terms(t, 5), samples) == [W.top_terms(s, 5) for s in samples]
    assert column(spark, T.canonical_key(F.lit("fact"), t), samples) == [W.canonical_key("fact", s) for s in samples]
    assert column(spark, T.estimate_tokens(t), samples) == [W.tokens(s) for s in samples]
    assert column(spark, T.concise(t, 20), samples) == [W.clip(s, 20) for s in samples]
    assert column(spark, C.revision_op(t), samples) == [W.op_of(s) for s in samples]
    assert column(spark, C.memory_kind(F.lit("x"), t), samples) == [W.kind_of("x", s) for s in samples]
    assert column(spark, T.fnv1a64(t, t), samples) == [W.fnv(s, s) for s in samples]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(4, 40))
def test_clip_keeps_whole_characters(text, limit):
    out = W.clip(text, limit)
    assert len(out.encode()) <= limit + 3
    squashed = " ".join(text.split())
    assert out == squashed or squashed.startswith(out.removesuffix("..."))


def test_merge_and_overlap(spark):
    t = F.col("t")
    assert column(spark, T.merge_texts(F.array(t, F.lit("b c"), t, F.lit("b"))), ["a"]) == ["a b c"]
    assert column(spark, T.overlap(T.terms(t), T.terms(F.lit("alpha gamma"))), ["alpha beta", ""]) == [1 / 3, 0.0]


def test_routing(spark):
    cases = {
        "current endpoint for svc3": (["state"], "state_intent", 0.85),
        "why did it fail with an error": (["gotcha", "procedural"], "gotcha_intent", 0.75),
        "tell me of apples": (C.MODES, "ambiguous_fallback", 0.2),
        "what happened": (["episodic", "semantic"], "ambiguous_fallback", 0.55),
        "who owns it": (["semantic"], "semantic_intent", 0.65),
    }
    got = column(spark, C.route(F.col("t")), list(cases))
    assert [(x["modes"], x["reason"], x["confidence"]) for x in got] == [tuple(v) for v in cases.values()]
    explicit = column(spark, C.route(F.col("t"), ["state"]), ["what happened"])[0]
    assert (explicit["modes"], explicit["reason"]) == (["state"], "ambiguous_fallback")
