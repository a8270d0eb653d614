"""Correlation, tests, trends, quantiles and distribution tables against numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions.tails import _make_chi2_tail, _make_f_tail
from cohortline.operators import correlation, distribution, inference, profile
from cohortline.operators.quantiles import Summary, _inside, describe, quantiles


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (2.0, 5.0, 0), (3.0, 5.0, 1)], "a double, b double, y int")
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None
    assert got["a", "a"] == pytest.approx(1.0)
    ordered = correlation.target_correlation(df, "y").collect()
    assert [r["variable"] for r in ordered] == ["a", "b"] and ordered[1]["correlation"] is None
    with pytest.raises(ValueError):
        correlation.target_correlation(df, "absent")


@pytest.mark.parametrize("width", [4, 15])
def test_pairwise_complete_matrix(spark, width):
    rng = random.Random(width)
    rows = [[None if rng.random() < 0.2 else rng.gauss(0, 1) + i for i in range(width)]
            for _ in range(300)]
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    want = df.toPandas().corr()
    assert len(got) == width * width
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-12)


def test_never_together_is_undefined_in_a_wide_matrix(spark):
    names = [f"c{i}" for i in range(14)]
    rows = [[float(i + j) if (j == 0) != (i % 2 == 0) or j > 1 else None for j in range(14)]
            for i in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert got["c0", "c1"] is None and got["c0", "c0"] == pytest.approx(1.0)


def test_matrix_leaves_out_keys(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, True, "x")],
                               "id_carrera int, a double, b double, c boolean, d string")
    assert {r[0] for r in correlation.correlation_matrix(df).collect()} == {"a", "b"}


def anova_rows(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return inference.anova(spark.createDataFrame(rows, "g string, v double"), "v", "g").first()


def test_anova(spark):
    groups = {"a": [1.0, 2.0, 3.0, None], "b": [2.0, 4.0, 6.0, 8.0], "c": [5.0, 5.5]}
    row = anova_rows(spark, groups)
    clean = {k: np.array([x for x in v if x is not None]) for k, v in groups.items()}
    everything = np.concatenate(list(clean.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in clean.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in clean.values()) / (len(everything) - 3)
    assert row["f_stat"] == pytest.approx(between / within)
    assert (row["df_between"], row["df_within"]) == (2, 6)
    assert 0 < row["p_value"] < 1 and not row["significant"]


def test_degenerate_anova(spark):
    one = anova_rows(spark, {"a": [1.0, 2.0]})
    assert one["f_stat"] is None and one["p_value"] is None and not one["significant"]
    equal = anova_rows(spark, {"a": [0.1, 0.1, 0.1], "b": [0.1, 0.1]})
    assert equal["f_stat"] is None
    apart = anova_rows(spark, {"a": [1.0, 1.0], "b": [2.0, 2.0]})
    assert math.isinf(apart["f_stat"]) and apart["p_value"] == 0 and apart["significant"]


def chi_rows(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(table) for j, n in enumerate(line)
            for _ in range(n)]
    return inference.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()


def test_chi_square(spark):
    yates = chi_rows(spark, [[10, 4], [3, 9]])
    assert yates["chi2"] == pytest.approx(3.8690476, abs=1e-7) and yates["dof"] == 1
    assert yates["p_value"] == pytest.approx(math.erfc(math.sqrt(yates["chi2"] / 2)))
    table = np.array([[5, 0, 7], [3, 4, 0], [0, 6, 2]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    row = chi_rows(spark, table.tolist())
    assert row["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row["dof"] == 4
    assert row["p_value"] == pytest.approx(math.exp(-row["chi2"] / 2) * (1 + row["chi2"] / 2))
    zero = chi_rows(spark, [[3, 0], [0, 4]])
    # the textbook form n (|ad - bc| - n/2)^2 / (product of the margins)
    assert zero["chi2"] == pytest.approx(7 * (12 - 3.5) ** 2 / (3 * 4 * 3 * 4))
    single = chi_rows(spark, [[3, 4]])
    assert (single["chi2"], single["dof"], single["p_value"]) == (0.0, 0, 1.0)


def test_expected_counts(spark):
    rows = [("x", 1)] * 3 + [("y", 2)] * 1
    df = spark.createDataFrame(rows, "a string, b int")
    got = {(r["a"], r["b"]): (r["n"], r["expected"]) for r in inference.expected_counts(df, "a", "b").collect()}
    assert got == {("x", 1): (3, 2.25), ("x", 2): (0, 0.75), ("y", 1): (0, 0.75), ("y", 2): (1, 0.25)}


def test_tails_against_closed_forms():
    f, chi2 = _make_f_tail(), _make_chi2_tail()
    for dof, x in [(2, 0.5), (2, 700.0), (4, 3.0), (4, 900.0), (1, 0.2), (1, 30.0)]:
        exact = {2: lambda x: math.exp(-x / 2), 4: lambda x: math.exp(-x / 2) * (1 + x / 2),
                 1: lambda x: math.erfc(math.sqrt(x / 2))}[dof](x)
        assert chi2(x, dof) == pytest.approx(exact, rel=1e-11)
    for within, x in [(2, 0.3), (10, 4.0), (100, 25.0), (100_000, 30.0), (10**9, 3.5)]:
        # two numerator degrees of freedom
        assert f(x, 2, within) == pytest.approx((1 + 2 * x / within) ** (-within / 2), rel=1e-6)
    # one denominator degree of freedom: an arc tangent
    assert f(3.0, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(3.0)), rel=1e-12)
    assert f(float("inf"), 1, 5) == 0.0 and f(None, 1, 5) is None and f(0.0, 1, 5) == 1.0
    # a large sample tends to the chi-square tail
    assert f(9.0, 1, 10**10) == pytest.approx(chi2(9.0, 1), rel=1e-6)


def test_trend_and_constant_x(spark):
    rows = [("a", float(x), 2.0 * x + 1) for x in range(5)] + [("b", 3.0, 1.0), ("b", 3.0, 2.0)]
    df = spark.createDataFrame(rows + [("a", None, 4.0)], "g string, x double, y double")
    got = {r["g"]: r for r in inference.linear_trend(df, "g", "x", "y").collect()}
    assert (got["a"]["slope"], got["a"]["intercept"], got["a"]["n"]) == (
        pytest.approx(2.0), pytest.approx(1.0), 5)
    assert got["b"]["slope"] is None


def test_band_covers_the_trend(spark):
    rng = random.Random(5)
    rows = [("g", f"e{i}", x := rng.uniform(50, 100), 0.1 * x + rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, e string, x double, y double")
    band = inference.trend_band(df, "g", "e", "x", "y", replicates=300, points=20).orderBy("point").collect()
    slope, base = np.polyfit([r[2] for r in rows], [r[3] for r in rows], 1)
    assert len(band) == 20
    assert all(r["low"] < base + slope * r["x"] < r["high"] for r in band)
    # the usual standard error of the fitted mean, at the middle of the data
    middle = min(band, key=lambda r: abs(r["x"] - np.mean([q[2] for q in rows])))
    residual = np.std([r[3] - base - slope * r[2] for r in rows])
    assert (middle["high"] - middle["low"]) == pytest.approx(2 * 1.96 * residual / 20, rel=0.2)
    again = inference.trend_band(df.repartition(7), "g", "e", "x", "y", replicates=300, points=20)
    assert [round(r["low"], 9) for r in again.orderBy("point").collect()] == [
        round(r["low"], 9) for r in band]


def test_quartiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    assert quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).first()["q"] == [1.75, 2.5, 4.75]


DRAWS = {
    "uniform": lambda rng: rng.uniform(-5, 5),
    # nearly all values close together, a few far off
    "outliers": lambda rng: 1e12 if rng.random() < 0.001 else rng.gauss(0, 1e-6),
    "copies": lambda rng: float(rng.choice([1, 1, 1, 1, rng.randint(0, 400)])),
    "half copies": lambda rng: 2.5 if rng.random() < 0.5 else rng.gauss(2.5, 1),
}


@pytest.mark.parametrize("kind", DRAWS)
def test_quantiles_of_many_values(spark, kind):
    """More distinct values than a summary holds: ranks are bracketed, then settled exactly."""
    rng = random.Random(kind)
    big = [("big", DRAWS[kind](rng)) for _ in range(60_000)]
    rows = big + [("small", float(i)) for i in range(7)] + [(None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", probabilities).collect()}
    assert got["big"] == pytest.approx(np.quantile([v for _, v in big], probabilities), rel=1e-12)
    assert got["small"] == pytest.approx(np.quantile(range(7), probabilities))
    assert got[None] == [3.0] * 7 and "none" not in got


def test_cells_of_a_column_stay_where_they_are(spark):
    """The brackets go to the rows: no task gets all cells of a column, however small the other side is."""
    df = spark.createDataFrame([(float(v),) for v in range(100)], "v double").repartition(3)
    found = spark.createDataFrame(
        [("v", [(None, 9.0), (40.0, 60.0)], [(0.5, 4, 5, None, None), (0.0, 50, 50, None, None)])],
        "_column string, open array<struct<above:double,upto:double>>, "
        "ranks array<struct<fraction:double,low_rank:bigint,high_rank:bigint,low:double,high:double>>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _inside(df, [], ["v"], found)
        assert {r["rank"]: r["kept"] for r in got.collect()} == {4: 4.0, 5: 5.0, 50: 50.0}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", DRAWS)
def test_summary_brackets_every_rank(kind):
    rng = random.Random(kind)
    values = np.array([DRAWS[kind](rng) for _ in range(30_000)])
    parts = [Summary(*np.unique(part, return_counts=True)).within(60) for part in np.array_split(values, 9)]
    whole = Summary.merged([Summary.merged(parts[:5], 60), Summary.merged(parts[5:], 60)], 60)
    assert len(whole.values) <= 61 and whole.weights.sum() == len(values)
    ordered = np.sort(values)
    for rank in [0, 1, *rng.sample(range(30_000), 300), 29_999]:
        above, upto = whole.bracket(rank)
        assert (above is None or above < ordered[rank] or above == upto) and ordered[rank] <= upto
    if whole.error:
        for bracket in map(whole.bracket, range(0, 30_000, 500)):
            low = -np.inf if bracket[0] is None else bracket[0]
            counts = np.unique(ordered[(ordered > low) & (ordered < bracket[1])], return_counts=True)[1]
            # but for one value with many copies, which is one row when counted
            assert counts.sum() - counts.max(initial=0) <= 2 * whole.error + len(values) / 60


def test_infinities_and_nan_end(spark):
    rng = random.Random(3)
    finite = [rng.uniform(-1e308, 1e308) for _ in range(9_000)]
    rows = [("g", v) for v in [*finite, *[float("inf")] * 2, *[float("-inf")] * 3, float("nan"), None]]
    df = spark.createDataFrame(rows, "g string, v double")
    ordered = sorted([*finite, *[float("inf")] * 2, *[float("-inf")] * 3])
    got = quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).first()["q"]
    assert got == [float("-inf"), ordered[4502], float("inf")]
    row = describe(df, ["g"], ["v"], [0.5]).first()
    assert (row["n_rows"], row["n"], row["v_min"], row["v_max"]) == (9007, 9005, float("-inf"), float("inf"))


def test_moments_of_all_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.gauss(1e6, 3), rng.choice([0.0, -1.0, None, float("nan"), 2.0])) for _ in range(5_000)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(7)
    for r in describe(df, ["g"], ["v", "w"], [0.1, 0.5]).collect():
        at = 1 if r["_column"] == "v" else 2
        x = np.array([row[at] for row in rows if row[0] == r["g"] and row[at] is not None and row[at] == row[at]])
        d = x - x.mean()
        assert [r[k] for k in ("mean", "m2", "m3", "m4")] == [
            pytest.approx(v, rel=1e-7, abs=1e-4) for v in (x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum())]
        assert (r["n"], r["n_zeros"], r["n_negative"]) == (len(x), (x == 0).sum(), (x < 0).sum())
        assert r["n_distinct"] == len(set(x)) and r["n_unique"] == sum(1 for v in set(x) if (x == v).sum() == 1)
        assert r["mad"] == pytest.approx(np.median(np.abs(x - np.median(x)))) and r["q"] == pytest.approx(
            np.quantile(x, [0.1, 0.5]))


def test_nan_is_no_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (float("nan"), 3.0), (3.0, 1.0), (4.0, 9.0), (5.0, 2.0)], "pf double, pa double")
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    x, y = [1, 3, 4, 5], [2, 1, 9, 2]
    assert got["pf", "pa"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_histogram_edges(spark):
    df = spark.createDataFrame(
        [(1, v) for v in (0.0, 1.0, 2.0, 20.0)] + [(2, 5.0)] * 3 + [(3, None)], "g int, v double")
    rows = distribution.histogram(df, "v", "g").collect()
    filled = {(r["g"], r["bin"]): r["n"] for r in rows if r["n"]}
    assert filled == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 20): 1, (2, 11): 3}
    assert len(rows) == 40


def test_histogram_equals_numpy(spark):
    rng = random.Random(3)
    data = [round(rng.uniform(0, 10), 1) for _ in range(3000)]
    df = spark.createDataFrame([(1, v) for v in data], "g int, v double")
    got = [r["n"] for r in distribution.histogram(df, "v", "g").orderBy("bin").collect()]
    assert got == np.histogram(data, bins=20)[0].tolist()


def test_kde_equals_the_formula(spark):
    rng = random.Random(9)
    data = [rng.choice([rng.gauss(6, 1), 8.0]) for _ in range(300)]
    df = spark.createDataFrame(
        [(1, v) for v in data] + [(2, 4.0), (2, 4.0), (3, 1.0), (1, 0.0)], "y int, v double")
    out = distribution.survival_kde(df, "v", "y").orderBy("point").collect()
    kept = np.array([v for v in data if v > 0])
    width = kept.std(ddof=1) * len(kept) ** -0.2
    grid = np.linspace(kept.min() - 3 * width, kept.max() + 3 * width, 200)
    density = np.exp(-0.5 * ((grid[:, None] - kept) / width) ** 2).sum(1) / (
        len(kept) * width * math.sqrt(2 * math.pi))
    assert {r["y"] for r in out} == {1} and len(out) == 200
    assert [r["x"] for r in out] == pytest.approx(grid)
    assert [r["density"] for r in out] == pytest.approx(density)


def test_box_whiskers(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 30.0]
    df = spark.createDataFrame([("a", v) for v in data] + [("a", None)], "g string, v double")
    row = distribution.box_summary(df, "v", ["g"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 5.0, 1)


def test_melt_takes_what_exists(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "resultado_final int, materias_reprobadas_totales int, "
                                               "`materias_reprobadas_física_química` double")
    columns = ["materias_reprobadas_totales", "materias_reprobadas_física_química", "absent"]
    got = sorted(tuple(r) for r in distribution.melt_backlog(df, columns).collect())
    assert got == [(1, "Física Química", 3.0), (1, "Totales", 2.0)]
    with pytest.raises(ValueError):
        distribution.melt_backlog(df, ["absent"])


def test_column_histograms_equal_numpy(spark):
    rng = random.Random(6)
    rows = [(round(rng.uniform(0, 10), 1), rng.choice([None, 7]), None) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(4)
    got = distribution.column_histograms(df, ["a", "b", "c"]).orderBy("column", "bin").collect()
    assert [r["n"] for r in got if r["column"] == "a"] == np.histogram([r[0] for r in rows], bins=20)[0].tolist()
    flat = {r["bin"]: (r["low"], r["n"]) for r in got if r["column"] == "b"}
    assert flat[11] == (7.0, sum(r[1] == 7 for r in rows)) and len(got) == 40


def test_infinite_value_is_no_correlation_of_its_pairs(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 5.0, 4.0), (float("inf"), 3.0, None), (3.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert got["a", "b"] is None
    assert got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 3], [1, 4, 2])[0, 1])
    assert got["b", "c"] == pytest.approx(np.corrcoef([2, 5, 9], [1, 4, 2])[0, 1])


def test_constant_column_over_many_tasks(spark):
    df = spark.createDataFrame([(0.1, float(i % 7)) for i in range(1_000)], "a double, b double").repartition(9)
    got = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["a", "a"] is None and got["b", "b"] == pytest.approx(1)


def test_extremes_count_over_tasks(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(40)), rng.choice([None, 1, 2])) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "a double, b int").repartition(6)
    counts = Counter(r[0] for r in rows)
    got = {(r["column"], r["side"], r["rank"]): (r["value"], r["n"]) for r in profile.extremes(df, 3).collect()}
    assert [got["a", "low", k] for k in (1, 2, 3)] == sorted(counts.items())[:3]
    assert [got["a", "high", k] for k in (1, 2, 3)] == sorted(counts.items())[::-1][:3]
    assert ("b", "low", 3) not in got and got["b", "high", 1][0] == 2


@pytest.mark.parametrize("most", [3, 8, 1_000])
def test_top_values_from_few_counters(spark, most):
    rng = random.Random(most)
    heavy = ["a"] * 900 + ["b"] * 700 + ["c"] * 700 + ["d"] * 500 + [f"v{i}" for i in range(800)]
    rows = [(rng.choice(heavy), f"u{rng.randrange(2_000)}", rng.choice([True, False, None]), None) for _ in range(6_000)]
    df = spark.createDataFrame(rows, "h string, f string, b boolean, e string").repartition(5)
    got = {}
    for r in profile.top_text_values(df, 3, most).collect():
        got.setdefault(r["column"], {})[r["rank"]] = (r["value"], r["n"])
    for at, name in ((0, "h"), (1, "f"), (2, "b")):
        counts = Counter(str(r[at]).lower() if at == 2 else r[at] for r in rows if r[at] is not None)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [got[name][k] for k in sorted(got[name])] == want
    assert "e" not in got


def test_distinct_sketches_add_up(spark):
    rows = [(i % 7, f"w{i % 5_000}", i % 3, None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, w string, x int, e string")
    sketches = profile.distinct_sketches(df, "g")
    assert sketches.count() == 21
    got = {r["column"]: r for r in profile.distinct_estimates(sketches).collect()}
    assert got["w"]["low"] <= 5_000 <= got["w"]["high"] < 5_600 and got["w"]["n_rows"] == 20_000
    assert got["x"]["n_distinct"] == 3 and got["e"]["n_distinct"] == 0


def test_duplicate_rows_and_overview(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, 1, "x"), (1, 2, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows * 2 + [(9, 9, "y")], "a int, b int, c string")
    got = {(r["a"], r["b"], r["c"]): r["n_copies"] for r in profile.duplicates(df).collect()}
    assert got == {k: n for k, n in Counter(rows * 2).items() if n > 1}
    whole = profile.overview(df).first()
    assert (whole["n_rows"], whole["n_missing_cells"], whole["n_duplicate_rows"]) == (13, 20, 8)
    assert profile.overview(df.limit(0)).first()["n_rows"] == 0


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1, 2.0)], "resultado_final int, v double")
    for call in (lambda: inference.anova(df, "absent", "resultado_final"),
                 lambda: inference.chi_square(df, "absent", "resultado_final"),
                 lambda: distribution.survival_kde(df, "absent")):
        with pytest.raises(ValueError, match="absent"):
            call()
