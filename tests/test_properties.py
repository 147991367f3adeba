"""Property tests (hypothesis) and the composite k-choice rule."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from consonance.operators import clusters, moments


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=1, max_value=12), min_size=1, max_size=4),
       dim=st.integers(min_value=1, max_value=6), seed=st.integers(min_value=0, max_value=10_000))
def test_closed_form_property(spark, sizes, dim, seed):
    rng = np.random.default_rng(seed)
    rows, expect = [], {}
    for g, n in enumerate(sizes):
        x = rng.normal(size=(n, dim))
        x[rng.random(n) < 0.2] = 0.0  # some zero vectors
        for i in range(n):
            rows.append(("m", f"t{g}", str(i), [float(v) for v in x[i]]))
        nrm = np.linalg.norm(x, axis=1)
        u = np.where(nrm[:, None] > 0, x / np.where(nrm > 0, nrm, 1)[:, None], 0)
        s = (u @ u.T)[np.triu_indices(n, k=1)]
        expect[f"t{g}"] = s
    df = spark.createDataFrame(rows, "model string, topic string, persona_id string, embedding array<double>")
    for r in moments.group_moments(df).collect():
        s = expect[r["topic"]]
        assert r["pairs"] == len(s)
        if len(s) == 0:
            assert r["mean_similarity"] is None
        else:
            assert -1 - 1e-9 <= r["mean_similarity"] <= 1 + 1e-9
            assert r["mean_similarity"] == pytest.approx(s.mean(), abs=1e-9)
            assert r["std_similarity"] == pytest.approx(s.std(), abs=1e-6)


def test_choose_k_rule(spark):
    inf = math.inf
    rows = [
        # group a: k=2 has all five; k=3 has only silhouette and CH; k=4 is a one-label fit (worst scores)
        ("a", 2, 0.5, 10.0, 2.0, 100.0, 90.0),
        ("a", 3, 0.6, 12.0, inf, inf, inf),
        ("a", 4, -1.0, 0.0, inf, inf, inf),
        # group b: equal composites -> the smaller k wins
        ("b", 2, 0.4, 1.0, inf, inf, inf),
        ("b", 3, 0.4, 1.0, inf, inf, inf),
    ]
    m = spark.createDataFrame(rows, "grp string, k int, silhouette double, calinski_harabasz double, "
                                    "davies_bouldin double, bic double, aic double")
    got = {r["grp"]: r for r in clusters.choose_k(m, ["grp"]).collect()}
    a2 = (0.5 + 10.0 + 1 / 2.0 + 1 / 100.0 + 1 / 90.0) / 5
    a3 = (0.6 + 12.0) / 2
    assert got["a"]["optimal_clusters"] == 3 and got["a"]["composite"] == pytest.approx(max(a2, a3))
    assert got["b"]["optimal_clusters"] == 2
