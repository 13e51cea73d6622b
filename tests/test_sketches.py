"""Reports of any period from stored days."""

import numpy as np

from tidewell.operators import sketches


def test_visitors_of_periods(spark):
    rng = np.random.default_rng(3)
    rows = [(t, int(v), f"2024-01-{d:02d} 12:00:00") for t, n in ((1, 5), (2, 40_000)) for d in range(1, 6) for v in rng.integers(0, n, 6000)] + [(3, None, "2024-01-02 00:00:00")]
    usage = spark.createDataFrame(rows, "tenant_id long, visitor_id long, created_at string")
    days = sketches.visitor_sketches(usage)
    for first, last in (("2024-01-01", "2024-01-05"), ("2024-01-02", "2024-01-03"), ("2024-01-04", "2024-01-04")):
        want = {t: {v for t2, v, at in rows if t2 == t and v is not None and first <= at[:10] <= last} for t in (1, 2, 3)}
        got = {r.tenant_id: r.visitors for r in sketches.visitors_between(days, first, last).collect()}
        assert got[1] == 5 and abs(got[2] - len(want[2])) <= 0.03 * len(want[2]) and got.get(3, 0) == 0
    assert sketches.visitors_between(days, "2025-01-01", "2025-01-02").count() == 0


def test_latency_of_periods(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x), f"2024-01-{d:02d} 12:00:00") for d in range(1, 5) for x in rng.lognormal(3, 1 + d / 4, 8000)] + [("b", 7.0, "2024-01-02 00:00:00"), ("b", None, "2024-01-02 00:00:00")]
    days = sketches.latency_sketches(spark.createDataFrame(rows, "stage string, ms double, created_at string"))
    got = {r.stage: r for r in sketches.latency_between(days, "2024-01-02", "2024-01-04").collect()}
    values = np.array([x for s, x, at in rows if s == "a" and at[:10] >= "2024-01-02"])
    assert got["a"].calls == len(values) and got["a"].max_ms == values.max() and tuple(got["b"]) == ("b", 1, 7.0, 7.0, 7.0)
    assert abs((values <= got["a"].p50_ms).mean() - 0.5) <= 0.01 and abs((values <= got["a"].p95_ms).mean() - 0.95) <= 0.01
