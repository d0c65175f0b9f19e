"""Ranks, running sums and quantiles in blocks, against pandas."""

import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    g = ["hot"] * 3000 + ["a"] * 40 + ["b"]
    p = pd.DataFrame({"g": g, "x": np.round(rng.normal(size=len(g)), 2), "id": rng.permutation(len(g))})
    return p, spark.createDataFrame(p)


@pytest.mark.parametrize("down", [True, False])
def test_ranks(rows, down):
    p, df = rows
    got = blocks.ranks(df, ["g"], "x", "id", down).toPandas().sort_values("id")["rank"].to_numpy()
    want = p.sort_values(["x", "id"], ascending=[not down, True]).groupby("g").cumcount() + 1
    assert (got == want.loc[p.sort_values("id").index].to_numpy()).all()


def test_running_sums(rows):
    p, df = rows
    got = blocks.running_sums(df, ["g"], "id", "x", True, "s").toPandas().sort_values("id")["s"].to_numpy()
    want = p.sort_values("id", ascending=False).groupby("g")["x"].cumsum()
    assert np.allclose(got, want.loc[p.sort_values("id").index])


def test_quantiles(rows, spark):
    p, df = rows
    got = blocks.quantiles(df, ["g"], "x", "id", (0, 0.5, 0.95, 1)).toPandas().set_index("g")
    for i, q in enumerate((0, 0.5, 0.95, 1)):
        assert np.allclose(got[f"q{i}"], p.groupby("g")["x"].quantile(q).loc[got.index])
    one = blocks.quantiles(df, [], "x", "id", (0.25,)).first()
    assert one.q0 == pytest.approx(p["x"].quantile(0.25))
    odd = spark.createDataFrame([(None, 1.0, 1), (None, None, 2), ("k", None, 3)], "g string, x double, id int")
    assert {r.g: r.q0 for r in blocks.quantiles(odd, ["g"], "x", "id", (0.5,)).collect()} == {None: 1.0}
    assert {r.id: r["rank"] for r in blocks.ranks(odd, ["g"], "x", "id").collect()} == {1: 1, 2: 2, 3: 1}
    assert blocks.ranks(odd.limit(0), ["g"], "x", "id").count() == 0
