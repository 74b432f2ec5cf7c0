import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm import mixing as M


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 900)), min_size=1, max_size=200), st.integers(0, 5))
def test_flight_keeps_totals_and_lands(units, seed):
    p, x = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    q = M.flight(p, x, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= M.LANDING
    assert q.sum() == pytest.approx(p.sum(), abs=1e-5) and (q * x).sum() == pytest.approx((p * x).sum(), rel=1e-5, abs=1e-2)


def test_flight_respects_probabilities():
    p, x = np.array([0.2, 0.5, 0.8, 0.5, 0.3, 0.7]), np.array([5, 9, 2, 7, 7, 1])
    mean = np.mean([M.flight(p, x, np.random.default_rng(s)) for s in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


DOCS = "doc_id long, text string, source string, tokens long, copies long, block long, prob double"


def docs(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = ["big", "big", "big", "mid", "mid", "small"][i % 6]
        rows.append((i, " ".join(["word"] * int(rng.integers(3, 120))), s, 0, 0, 0, 0.0))
    return rows


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_levels(spark):
    goal = targets(spark, [("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.3, 3), ("gone", 0.0, 1)])
    chosen, plan = M.mix(spark.createDataFrame(docs(spark), DOCS), goal, block=24)
    got = chosen.toPandas()
    assert not got.doc_id.duplicated().any() and (got.copies >= 1).all()
    for s, cap in (("big", 1), ("mid", 2), ("small", 3)):
        assert got[got.source == s].copies.max() <= cap
    rep = {r.source: r for r in M.shares(chosen, plan).collect()}
    for s, share in (("big", 0.3), ("mid", 0.4), ("small", 0.3)):
        assert rep[s].actual_share == pytest.approx(share, abs=0.004)
    again = M.mix(spark.createDataFrame(docs(spark), DOCS), goal, block=24)[0].toPandas()
    assert sorted(zip(got.doc_id, got.copies)) == sorted(zip(again.doc_id, again.copies))


def test_total_and_missing_source(spark):
    goal = targets(spark, [("big", 0.5, 1), ("mid", 0.25, 1), ("gone", 0.25, 4), (None, 0.5, 1), ("mid", None, 1)])
    chosen, plan = M.mix(spark.createDataFrame(docs(spark), DOCS), goal, total_tokens=3000)
    rep = {r.source: r for r in M.shares(chosen, plan).collect()}
    assert set(rep) == {"big", "mid", "gone"} and not rep["gone"].reachable and rep["gone"].tokens == 0
    assert rep["big"].tokens == pytest.approx(2000, abs=130) and rep["mid"].tokens == pytest.approx(1000, abs=130)


def test_dirt_and_empty(spark):
    rows = [(1, None, "big", 0, 0, 0, 0.0), (2, "", "big", 0, 0, 0, 0.0), (None, "a b", "big", 0, 0, 0, 0.0), (3, "a b", None, 0, 0, 0, 0.0), (4, "a b", "other", 0, 0, 0, 0.0), (5, "a b c", "big", 0, 0, 0, 0.0), (5, "a b c", "big", 0, 0, 0, 0.0)]
    goal = targets(spark, [("big", 1.0, 2)])
    got = M.mix(spark.createDataFrame(rows, DOCS), goal)[0].collect()
    assert [(r.doc_id, r.copies) for r in got] == [(5, 2)]
    assert M.mix(spark.createDataFrame([], DOCS), goal)[0].count() == 0
    chosen, plan = M.mix(spark.createDataFrame(rows, DOCS), targets(spark, []))
    assert chosen.count() == 0 and M.shares(chosen, plan).count() == 0


def test_token_counts_match_the_other_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Plain words, here.", "Größe & señal 12.5", "x" * 5000, "  spaces   and\ttabs\n"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    df = spark.createDataFrame([(i, x, "s", 0, 0, 0, 0.0) for i, x in enumerate(texts)], DOCS)
    assert [r.tokens for r in M.token_counts(df, "doc_id", "text", "source").orderBy("doc_id").collect()] == want
