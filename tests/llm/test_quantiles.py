import numpy as np
import pytest

from aerolith.llm import quantiles as Q


def rank_off(data, got, p):
    """How many ranks ``got`` lies away from the ranks of p * (n - 1)."""
    s = np.sort(data)
    h = p * (len(s) - 1)
    lo, hi = np.searchsorted(s, got, "left"), np.searchsorted(s, got, "right") - 1
    return max(0.0, lo - np.ceil(h), np.floor(h) - hi)


@pytest.mark.parametrize("shape", ["sorted", "reversed", "random", "ties", "lognormal"])
def test_error_stays_within_the_certified_bound(shape):
    rng = np.random.default_rng(1)
    n = 300_000
    data = {"sorted": np.arange(n, dtype=float), "reversed": np.arange(n, dtype=float)[::-1], "random": rng.random(n), "ties": rng.integers(0, 5, n).astype(float), "lognormal": rng.lognormal(0, 3, n)}[shape]
    s = Q.Sketch(k=128, b=4)
    for part in np.array_split(data, 37):
        s.add(part)
    ps = [0.0, 0.01, 0.5, 0.9, 0.95, 0.999, 1.0]
    bound = s.rank_error()
    assert s.n == n and 0 < bound < 0.05 * n
    assert sum(w for _, w, _ in s.full) * 128 + s.tail_n == n
    for p, v in zip(ps, s.quantiles(ps)):
        assert rank_off(data, v, p) <= bound + 1
    assert len(s.full) <= 3 * (1 + max(x[0] for x in s.full))


def test_merging_in_any_order_keeps_count_and_bound():
    rng = np.random.default_rng(2)
    data = rng.normal(size=60_000)
    parts = np.array_split(data, 23)
    for order in (range(23), reversed(range(23)), rng.permutation(23)):
        total = Q.Sketch(k=64, b=5)
        for i in order:
            s = Q.Sketch(k=64, b=5)
            s.add(parts[i])
            total.merge(s.n, s.moved, s.full, np.concatenate(s.tail) if s.tail else np.empty(0))
        assert total.n == len(data)
        for p in (0.05, 0.5, 0.95):
            assert rank_off(data, total.quantiles([p])[0], p) <= total.rank_error() + 1


def test_exact_while_nothing_collapses():
    rng = np.random.default_rng(3)
    data = rng.normal(size=2000)
    s = Q.Sketch(k=512, b=4)
    s.add(data)
    assert s.rank_error() == 0
    assert np.allclose(s.quantiles([0.1, 0.5, 0.95]), np.quantile(data, [0.1, 0.5, 0.95]))


def test_groups_over_partitions_and_tree(spark):
    rng = np.random.default_rng(4)
    data = [("hot" if i % 3 else f"g{i % 7}", float(v), None if i % 5 == 0 else float(v) * 2, "x") for i, v in enumerate(rng.random(6000))]
    df = spark.createDataFrame(data, "g string, a double, b double, metric string").repartition(9)
    parts = Q.sketches(df, ["g"], ["a", "b"], k=32, b=4)
    merged = Q.merge(parts, ["g"], 9, k=32, b=4, fan_in=2)
    rows = Q.percentiles(merged, ["g"], [0.5, 0.95], k=32, b=4).collect()
    assert len(rows) == len({(r["g"], r["metric"]) for r in rows}) == 2 * len({d[0] for d in data})
    for r in rows:
        mine = np.array([d[1 if r["metric"] == "a" else 2] for d in data if d[0] == r["g"]], dtype=float)
        mine = mine[~np.isnan(mine)]
        assert r["n"] == len(mine)
        for p, v in zip((0.5, 0.95), r["qs"]):
            assert rank_off(mine, v, p) <= r["max_rank_error"] + 1


def test_no_values_null_groups_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", 1.0), ("a", 1.0), ("a", nan), ("a", inf), ("a", -1.0), ("a", None), (None, 3.0), ("b", None)]
    df = spark.createDataFrame(data, "g string, v double")
    rows = {r["g"]: (r["n"], r["qs"]) for r in Q.group_percentiles(df, ["g"], ["v"], [0.5]).collect()}
    assert rows == {"a": (2, [1.0]), None: (1, [3.0])}
    assert Q.group_percentiles(df.limit(0), ["g"], ["v"], [0.5]).count() == 0
