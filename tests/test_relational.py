"""Affinity, blocks, components, copula and selection on hand-checked cases."""

from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkslab.operators import affinity, blocks, copula, factor, relevance, selection
from sparkslab.operators.components import connected_components
from sparkslab.sources.tables import write_csv


def test_extent_affinity(spark):
    f = spark.createDataFrame([(0, 1000.0)], "feature_id long, s double")
    g = spark.createDataFrame([(0, 980.0, 995.0, 1.0), (1, 1020.0, 1030.0, 1.0), (2, 2000.0, 2001.0, 1.0)], "group_id long, l double, r double, relevance double")
    got = {r.group_id: r.a for r in affinity.extent_affinity(f, g, 10.0).collect()}
    assert set(got) == {0, 1} and abs(got[0] - 0.2858) < 1e-4 and abs(got[1] - 0.0214) < 1e-4
    assert affinity.extent_affinity(f, g, 0.0).count() == 0


def test_points_causal_graph(spark):
    f = spark.createDataFrame([(0, [0.0, 0.0])], "feature_id long, f array<double>")
    g = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "group_id long, c array<double>")
    got = {r.group_id: r.a for r in affinity.point_affinity(f, g, 1.0).collect()}
    assert got[0] == 1.0 and abs(got[1] - np.exp(-25)) < 1e-15
    t = spark.createDataFrame([(0, 100.0)], "feature_id long, t double")
    e = spark.createDataFrame([(0, 80.0, 90.0), (1, 95.0, 110.0), (2, 120.0, 130.0)], "group_id long, l double, r double")
    assert [(r.group_id, round(r.a, 6)) for r in affinity.causal_affinity(t, e, 10.0).collect()] == [(0, 0.367879)]
    d = spark.createDataFrame([(0, 1, 1.0), (0, 2, 5.0)], "src long, dst long, d double")
    assert [round(r.a, 6) for r in affinity.graph_affinity(d, 2.0).orderBy("dst").collect()] == [0.606531, 0.082085]


def test_contract_and_fit(spark):
    f = spark.createDataFrame([(0,), (1,), (2,)], "feature_id long")
    p = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5)], "feature_id long, group_id long, a double")
    g = spark.createDataFrame([(0, 2.0), (1, 4.0)], "group_id long, relevance double")
    assert [round(r.wr, 6) for r in affinity.contract(f, p, g).orderBy("feature_id").collect()] == [0.666667, 1.0, 0.0]
    pairs = spark.range(1, 200).select((F.col("id") * 3.0).alias("d")).withColumn("target", 2 * affinity.ndtr(-F.col("d") / 80))
    assert abs(affinity.fit_bandwidth(pairs) / 80 - 1) < 0.15


def test_merge_and_blocks(spark):
    x = spark.createDataFrame([(100.0, 200.0, 1.0), (500.0, 700.0, 2.0)], "l double, r double, relevance double")
    assert [tuple(r) for r in blocks.merge_extents(x).orderBy("start").collect()] == [(100.0, 200.0, 1.0), (200.0, 500.0, 0.0), (500.0, 700.0, 2.0)]
    f = spark.createDataFrame(list(enumerate([0.0, 1.0, 2.0, 10.0, 11.0, 30.0])), "feature_id long, s double")
    assert [r.block_id for r in blocks.threshold_blocks(f, 3.0).orderBy("feature_id").collect()] == [0, 0, 0, 1, 1, 2]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, edges):
    label = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges or [(None, None)], "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == label


def test_components_of_a_long_path(spark):
    ids = np.random.default_rng(1).permutation(1000).tolist()
    got = connected_components(spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long"))
    assert [r.component for r in got.collect()] == [0] * 1000


def test_copula(spark):
    v = [3.0, 1.0, 1.0, 7.0, 5.0, 3.0, 3.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    e = {r.v: (r.u_low, r.u_high) for r in copula.ecdf(df).collect()}
    assert e[1.0] == (0.5 / 7, 1.5 / 7) and e[3.0] == (2.5 / 7, 4.5 / 7)
    q = spark.createDataFrame([(-9.0,), (2.0,), (3.0,), (6.0,), (99.0,)], "v double")
    xs, us = np.sort(v), (np.arange(1, 8) - 0.5) / 7
    u = copula.interpolate(q, copula.ecdf(df), "v", "v", "u_low", "u_high").orderBy("v").collect()
    assert np.allclose([r.u for r in u], np.interp([-9, 2, 3, 6, 99], xs, us))
    z = copula.to_gaussian(df.where("v <> 3"), df)
    assert all(abs(r.v - r.x) < 1e-6 for r in copula.from_gaussian(z, df).where("v > 1").collect())
    with pytest.raises(ValueError):
        copula.fit_parametric(df, "nothing")


def test_selection_and_relevance(spark):
    pi = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.1), (3, 0.05)], "feature_id long, pi double")
    assert [r.selected for r in selection.centroid(pi).orderBy("feature_id").collect()] == [True, True, False, False]
    assert abs(selection.embfdr(pi.withColumnRenamed("pi", "theta")).first().embfdr - 0.15) < 1e-12
    st_ = selection.stability_pairs(spark, lambda idx: np.flatnonzero(idx < 2), 9, n_pairs=6).orderBy("feature_id").collect()
    assert [r.stability for r in st_] == [1.0, 1.0] + [0.0] * 7 and all(r.candidate == 6 for r in st_)
    t = spark.createDataFrame([(0, "insulin and glucose metabolism"), (1, "stellar parallax"), (2, None)], "group_id long, text string")
    r = {x.group_id: x.relevance for x in relevance.TfidfRelevance().score(t, "glucose and insulin").collect()}
    assert r[0] > r[1] == r[2] == 0.0


def test_shrunk_direction_needs_only_the_covariance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 1)) * np.linspace(0.5, 1.5, 6) + rng.normal(size=(300, 6)) * 0.5
    cov = np.cov(x.T, bias=True)
    f = factor.sar_shrink(x.mean(0), cov, 300, np.arange(6.0), phi=1.0)
    assert np.all(f.loading > 0) and np.corrcoef(f.loading, np.linspace(0.5, 1.5, 6))[0, 1] > 0.9
    assert np.allclose(factor.sar_matrix(np.arange(3.0), 2.0), factor.sar_matrix(np.arange(3.0)[:, None], 2.0))


def test_bandwidth_of_gaps_and_correlations(spark):
    same = spark.createDataFrame([(0, 5.0), (1, 5.0)], "feature_id long, s double")
    assert affinity.auto_bandwidth(same) == 1.0 and affinity.auto_bandwidth(same.limit(0)) == 1.0
    some = spark.createDataFrame([(0, 5.0), (1, 7.0), (2, None), (3, 13.0), (4, 14.0)], "feature_id long, s double")
    assert affinity.auto_bandwidth(some) == 2.0
    assert blocks.gap_percentile(some, 1.0) == 6.0
    places = spark.createDataFrame([(j, float(j)) for j in range(6)], "feature_id long, s double")
    r = [(i, j, 2 * NormalDist().cdf(-(j - i) / 3.0)) for i in range(6) for j in range(6)] + [(0, 1, float("nan"))]
    pairs = affinity.correlation_pairs(places, spark.createDataFrame(r[:-1], "i long, j long, r double"))
    assert pairs.count() == 15 and abs(affinity.fit_bandwidth(pairs, (0.1, 100.0)) - 3.0) < 0.01
    undefined = affinity.correlation_pairs(places, spark.createDataFrame(r[-1:], "i long, j long, r double"))
    assert undefined.first().target == 0.0


def test_no_bandwidth_no_pairs(spark):
    f = spark.createDataFrame([(0, 1.0, 1.0, None)], "feature_id long, s double, t double, phi double")
    g = spark.createDataFrame([("a", 0.0, 2.0)], "group_id string, l double, r double")
    for got in (affinity.extent_affinity(f, g, 0.0), affinity.extent_affinity(f, g, "phi"), affinity.causal_affinity(f, g, 0.0)):
        assert got.columns == ["feature_id", "group_id", "a"] and got.count() == 0


def test_selection_quality_and_csv(spark, tmp_path):
    rows = [(0, True, True), (0, False, True), (0, True, None), (1, False, False), (1, None, False)]
    got = selection.selection_quality(spark.createDataFrame(rows, "draw int, selected boolean, is_causal boolean"), ["draw"])
    assert {r.draw: (r.true_positives, r.n_selected, r.power, r.precision) for r in got.collect()} == {0: (1, 2, 0.5, 0.5), 1: (0, 0, None, None)}
    write_csv(got, str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == 2
    assert [r.f for r in selection.admit(spark.createDataFrame([("a", 0.6), ("b", 0.5)], "f string, stability double"), 0.5).collect()] == ["a"]
