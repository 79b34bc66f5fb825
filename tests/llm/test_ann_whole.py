"""Every query has its k neighbours where there are as many candidates."""

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import ann


def test_the_seeds_of_the_limit_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "MIN_PROBED", 1)
    monkeypatch.setattr(ann, "probes_needed", lambda *a, **k: 1)  # near seeds lie in lists that aren't probed
    v = np.random.default_rng(3).standard_normal((1000, 16))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    rows = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == set(range(0, 1000, 50))
    for q, found in got.items():
        assert len({i for i, _ in found}) == 5 == len(found) and q not in {i for i, _ in found}
        assert all(abs(u[q] @ u[i] - s) < 1e-9 for i, s in found)
