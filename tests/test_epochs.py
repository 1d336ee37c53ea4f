"""Training by epochs: it learns, keeps the best epoch, and goes on after a kill."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from headline_signals.plans import epochs as ep
from headline_signals.session import scratch_path
from headline_signals.sources import generations as gn


def rows(spark, n=300):
    words = ["loss fall drop", "flat calm", "gain rise jump"]
    data = [(f"{words[i % 3]} noise{i % 17} word{i % 5}", i % 3) for i in range(n)] + [(None, 1), ("gain", None)]
    return spark.createDataFrame(data, "text string, label int").repartition(3)


def test_epochs_learn_and_resume(spark, monkeypatch):
    root = scratch_path(spark, f"t-epochs-{uuid.uuid4().hex}")
    train, held = rows(spark), rows(spark, 60)
    whole = ep._epoch
    monkeypatch.setattr(ep, "_epoch", lambda t, w, e: whole(t, w, e) if e < 3 else pytest.fail("killed"))
    with pytest.raises(BaseException, match="killed"):
        ep.train_epochs(train, held, root)
    before = [(g.number, g.notes) for g in gn.generations(spark, f"{root}/epochs")]
    assert [n["epoch"] for _, n in before] == ["1", "2"]
    seen = []
    monkeypatch.setattr(ep, "_epoch", lambda t, w, e: seen.append(e) or whole(t, w, e))
    model, report = ep.train_epochs(train, held, root)
    assert seen == [3] and [(g.number, g.notes) for g in gn.generations(spark, f"{root}/epochs")][:2] == before
    scores = {r["epoch"]: r for r in report.collect()}
    assert set(scores) == {1, 2, 3} and sum(r["chosen"] for r in scores.values()) == 1
    best = max(scores.values(), key=lambda r: (r["f1"], -r["epoch"]))
    assert best["chosen"] and model.epoch == best["epoch"] and model.f1 == best["f1"] > 0.95
    pairs = [tuple(r) for r in model.predictions(ep.hashed(held, "text", "label")).collect()]
    assert len(pairs) == 61 and np.mean([a == b for a, b in pairs]) > 0.95


def test_weighted_f1(spark):
    pairs = spark.createDataFrame([(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)], "label int, prediction int")
    want = (8 * (12 / 14) + 3 * (6 / 9) + 1 * 0) / 12
    assert abs(ep.weighted_f1(pairs) - want) < 1e-12 and ep.weighted_f1(pairs.where(F.lit(False))) == 0.0
