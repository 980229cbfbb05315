from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tickstone.llm.mixing import Raking, _scaled, calibrated, measured, mix_report, mixed_sample, rake, reached, with_target
from tickstone.llm.tokens import DEFAULT, counter

SIZED = "doc_id bigint, source string, lang string, topic string, tokens bigint"
TARGETS = "source string, target_share double, max_passes int"


def sized(spark, seed=0, n=3000):
    rng = np.random.default_rng(seed)
    rows = [(i, str(rng.choice(["a", "a", "a", "b", "c", "d"])), str(rng.choice(["en", "en", "de"])), str(rng.choice(["x", "y"])), int(rng.integers(1, 500))) for i in range(n)]
    return spark.createDataFrame(rows, SIZED)


def test_raking_meets_targets(spark):
    s = sized(spark)
    t = spark.createDataFrame([("a", 0.25, 1), (" B", 0.25, 4), ("c", 0.5, 2), ("none", 0.0, 3)], TARGETS)
    r = {x.source: x for x in mix_report(s, t).collect()}
    assert abs(r["a"].share_of_total - 0.25) < 1e-6 and abs(r["b"].share_of_total - 0.25) < 1e-6
    assert r["c"].short and r["c"].passes == 2.0 and r["c"].mix_tokens == 2 * r["c"].own_tokens
    assert not r["none"].short and r["none"].own_tokens == 0 and "d" not in r
    cells, _ = calibrated(s, t)
    passes = cells["source"].map({"a": 1, "b": 4, "c": 2})
    assert (cells["weight"] <= passes + 1e-9).all()
    # languages keep their shares as far as the sources allow
    by = (cells.tokens * cells.weight).groupby(cells.lang).sum()
    own = cells.tokens.groupby(cells.lang).sum()
    assert abs((by / by.sum() - own / own.sum()).abs().max()) < 0.02


def test_raking_keeps_free_marginals():
    cells = pd.DataFrame([("a", "en", "x", 100), ("a", "de", "x", 100), ("b", "en", "x", 300), ("b", "de", "x", 100)], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.5, 9), ("b", 0.5, 9)], columns=["source", "target_share", "max_passes"])
    out, _ = rake(cells, targets)
    used = out.tokens * out.weight
    assert np.allclose(used.groupby(out.source).sum(), [300, 300]) and np.allclose(used.groupby(out.lang).sum().loc[["en", "de"]], [400, 200])


def test_sample_is_calibrated_and_repeatable(spark):
    s = sized(spark)
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 4), ("c", 0.4, 1)], TARGETS)
    x = mixed_sample(s, t)
    a, b = x.toPandas(), mixed_sample(s.repartition(3), t).toPandas()
    assert sorted(zip(a.doc_id, a.copies, strict=True)) == sorted(zip(b.doc_id, b.copies, strict=True))
    assert (a.copies <= np.ceil(a.weight)).all() and (a.copies >= np.floor(a.weight)).all()
    want = {r.source: r.share_of_mix for r in mix_report(s, t).collect()}
    for r in reached(x).collect():
        assert abs(r.share - want[r.source]) < 0.03
    assert a[a.source == "c"].copies.eq(1).all() and len(a[a.source == "c"]) == s.where("source = 'c'").count()


def test_empty_and_odd(spark):
    t = spark.createDataFrame([("a", 0.5, 2), ("A ", 0.1, 1), (None, 0.4, 1)], TARGETS)
    empty = sized(spark).limit(0)
    r = mix_report(empty, t).collect()
    assert len(r) == 1 and r[0].target_share == 0.6 and r[0].share_of_mix == 0.0 and not r[0].short
    assert {r.doc_id for r in with_target(spark.createDataFrame([(1, " A"), (2, "b"), (3, None)], "doc_id bigint, source string"), t).collect()} == {1}
    assert mixed_sample(empty, t).count() == 0 and reached(mixed_sample(empty, t)).count() == 0
    assert mix_report(sized(spark), t.limit(0)).count() == 0
    zero = spark.createDataFrame([(1, "a", "en", "x", 0), (2, None, "en", "x", 5)], SIZED)
    assert mix_report(zero, t).first().mix_tokens == 0.0


def test_scaled():
    one = np.array([0, 0])
    assert np.allclose(_scaled(np.array([1.0, 1.0]), np.array([1.0, 3.0]), np.array([2.0, 2.0]), one, np.array([3.0])), [1.0, 2.0])
    assert np.allclose(_scaled(np.array([1.0]), np.array([1.0]), np.array([2.0]), one[:1], np.array([9.0])), [2.0])
    assert np.allclose(_scaled(np.array([1.0]), np.array([1.0]), np.array([2.0]), one[:1], np.array([0.0])), [0.0])
    two = _scaled(np.array([1.0, 1.0, 4.0, 0.0]), np.array([1.0, 3.0, 1.0, 1.0]), np.array([2.0, 2.0, 5.0, 5.0]), np.array([0, 0, 1, 1]), np.array([3.0, 8.0]))
    assert np.allclose(two[:3], [1.0, 2.0, 2.0])


def test_short_is_told_from_the_raked_weights():
    cells = pd.DataFrame([("a", "en", "x", 100), ("b", "en", "x", 300), ("c", "de", "y", 600)], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.5, 3), ("b", 0.2, 4), ("c", 0.3, 1), ("gone", 0.0, 1)], columns=["source", "target_share", "max_passes"])
    assert list(rake(cells, targets)[1].short) == [True, False, False, False]
    # without a round of raking no weight stands at its cap, though the same passes are too few
    assert not rake(cells, targets, Raking(rounds=0))[1].short.any()
    exact = pd.DataFrame([("a", 0.3, 3), ("b", 0.7, 4)], columns=["source", "target_share", "max_passes"])
    assert not rake(cells.assign(tokens=[100, 900, 5]), exact)[1].short.any()  # just enough is enough
    report = rake(cells, targets)[1]
    assert report.rounds.iloc[0] >= 1 and report.moved.iloc[0] <= 1e-9 and 0 <= report.lang_off.iloc[0] <= 1


@pytest.mark.parametrize("path", [DEFAULT, DEFAULT.replace("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"), DEFAULT.replace("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")])
def test_tokens(path):
    n = counter(path)([None, "", "hello world", "<|endoftext|>", "x" * 20_000])
    assert n[:2] == [0, 0] and n[2] >= 2 and n[3] > 1 and n[4] > 100


def test_measured(spark):
    docs = spark.createDataFrame([(1, "Crude oil rose. Oil fell.", " Wire ", "EN"), (2, None, None, None), (3, "  ", "wire", ""), (4, "x", "w w", "de"), (2**60 + 1, "x", "w", "de"), (None, "x", "w", "de")], "doc_id bigint, text string, source string, lang string")
    subjects = spark.createDataFrame([("energy",)], "subject string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    got = {r.doc_id: r for r in measured(docs, subjects, labels).collect()}
    assert got[1].source == "wire" and got[1].tokens == counter()(["Crude oil rose. Oil fell."])[0] and got[1].topic == "none" and got[1].lang == "en"
    assert got[2**60 + 1].tokens == 1 and got[None].tokens == 1
    assert got[2].tokens == 0 and got[2].source is None and got[2].lang == "und" and got[3].tokens == 0 and got[4].source == "w_w"
