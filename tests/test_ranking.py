"""Distributed ranks against plain ones, with ranges forced on a small table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import ranking


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "b", None], n), "v": np.round(rng.normal(size=n), 2), "w": rng.integers(1, 5, n)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 0.5  # a hot value
    return pdf, spark.createDataFrame(pdf).repartition(7).persist()


@pytest.mark.parametrize("mod", [1, 3, 1024])
def test_cumulative(frame, mod):
    pdf, df = frame
    got = ranking.cumulative(df, ["g"], ["v"], sample_mod=mod, ranges=200 if mod == 1 else 8).toPandas()
    counts = pdf.fillna({"g": "-"}).groupby(["g", "v"]).size().rename("n").reset_index()
    counts["upto"] = counts.groupby("g")["n"].cumsum()
    counts["total"] = counts.groupby("g")["n"].transform("sum")
    got = got.fillna({"g": "-"}).sort_values(["g", "v"]).reset_index(drop=True)
    for c in ("n", "upto", "total"):
        assert (got[c].to_numpy() == counts[c].to_numpy()).all()
    assert (got["below"] == got["upto"] - got["n"]).all()


def test_weighted_without_group(frame):
    pdf, df = frame
    got = ranking.cumulative(df, [], ["v"], weight="w", sample_mod=2, ranges=16).orderBy("v").toPandas()
    want = pdf.groupby("v")["w"].sum().sort_index().cumsum()
    assert (got["upto"].to_numpy() == want.to_numpy()).all()


def test_suffix_min(frame):
    pdf, df = frame
    one = df.groupBy("g", "v").agg(F.avg("w").alias("x"))
    got = ranking.suffix_min(one, ["g"], "v", "x", "m", sample_mod=1, ranges=8).toPandas().fillna({"g": "-"}).sort_values(["g", "v"])
    for _, part in got.groupby("g"):
        assert np.allclose(part["m"], part["x"][::-1].cummin()[::-1])


@pytest.mark.parametrize("mod", [1, 1024])
def test_quantiles(frame, mod, monkeypatch):
    pdf, df = frame
    monkeypatch.setattr(ranking.cumulative, "__defaults__", (None, None, mod, 8))
    got = ranking.grouped_quantiles(df.where("g is not null"), ["g"], "v", {"a": 0.25, "b": 0.977}).toPandas().set_index("g")
    for g, part in pdf.dropna().groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b"]].astype(float), np.quantile(part["v"], [0.25, 0.977]))


def test_ranges_rise_with_the_value(frame):
    pdf, df = frame
    one = df.select("g", "v").distinct()
    for ranges in (5, 300):
        got = ranking.with_ranges(one, ["g"], "v", 1, ranges).toPandas()
        for _, part in got.groupby("g", dropna=False):
            part = part.sort_values("v")
            assert part["_range"].is_monotonic_increasing and part["_range"].nunique() >= min(ranges, 100) - 1
