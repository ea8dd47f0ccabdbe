import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodica.operators import density as dn
from episodica.operators import sampling as sp


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    # person 0 owns a third of the rows
    data = [(i, 0 if i % 3 == 0 else int(rng.integers(1, 80)), int(rng.random() < 0.25), rng.normal(size=4).tolist()) for i in range(900)]
    return spark.createDataFrame(data, "id long, person long, y int, x array<double>").cache()


def test_folds(rows):
    out = sp.assign_folds(rows.filter("person > 0"), "person", "y", 5)
    assert out.groupBy("person").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    shares = [r.s for r in out.groupBy("fold").agg(F.avg("y").alias("s")).collect()]
    overall = rows.filter("person > 0").agg(F.avg("y")).first()[0]
    assert len(shares) == 5 and max(abs(s - overall) for s in shares) < 0.06
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) < 40


def test_folds_do_not_depend_on_partitions(rows):
    a = sp.assign_folds(rows, "person", "y", 3)
    b = sp.assign_folds(rows.repartition(7), "person", "y", 3)
    assert sorted((r.id, r.fold) for r in a.collect()) == sorted((r.id, r.fold) for r in b.collect())


def placed_one_by_one(runs, k):
    """The sequential rule, group by group; (events, others) per fold."""
    total = np.maximum(1, sum(np.array(r[:2]) * r[2] for r in runs))
    held = np.zeros((k, 2))
    for e, o, n in runs:
        for _ in range(n):
            tried = [(held + np.eye(k)[:, [i]] * (e, o)) / total for i in range(k)]
            spread = [round(t.std(axis=0).sum(), 12) for t in tried]
            held[int(np.argmin(spread))] += (e, o)
    return held


def test_blocks_of_equal_groups_spread_no_wider_than_single_groups():
    rng = np.random.default_rng(4)
    for _ in range(12):
        k = int(rng.integers(2, 7))
        runs = [(int(rng.integers(0, 40)), int(rng.integers(0, 200)), int(rng.integers(1, 400))) for _ in range(8)]
        runs = sorted(runs, key=lambda r: (-abs(r[0] - r[1]), -r[0])) + [(1, 0, 30), (0, 1, 700), (0, 0, 9)]
        total = sum(np.array(r[:2]) * r[2] for r in runs)
        held = np.zeros((k, 2))
        for (e, o, n), blocks in zip(runs, sp.fold_blocks(runs, k)):
            assert blocks[-1][0] == n
            for (upto, fold), before in zip(blocks, [0, *[b[0] for b in blocks]]):
                held[fold] += (upto - before) * np.array((e, o))
        assert (held.sum(axis=0) == total).all()
        single = (placed_one_by_one(runs, k) / total).std(axis=0).sum()
        assert (held / total).std(axis=0).sum() <= single + 0.002


def test_short_runs_are_placed_one_by_one():
    runs = [(9, 1, 2), (0, 5, 6), (2, 2, 31), (1, 2, 17), (0, 1, 40), (1, 0, 3)]
    held = np.zeros((3, 2))
    for (e, o, _), blocks in zip(runs, sp.fold_blocks(runs, 3)):
        assert [b[0] for b in blocks] == list(range(1, len(blocks) + 1))
        for _, fold in blocks:
            held[fold] += (e, o)
    assert (held == placed_one_by_one(runs, 3)).all()


def test_folds_of_many_equal_groups_one_huge_group_and_no_rows(spark):
    made = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id")).alias("person"),
                                      F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(0).alias("y"))
    out = sp.assign_folds(made, "person", "y", 4)
    rows = {r.fold: (r.events, r.n) for r in out.groupBy("fold").agg(F.sum("y").alias("events"), F.count("*").alias("n")).collect()}
    assert sum(n for _, n in rows.values()) == 30_000 and set(rows) == {0, 1, 2, 3}
    alone = out.filter("person = -1").first().fold
    events = sorted(e for f, (e, _) in rows.items() if f != alone)
    assert rows[alone][0] == 200 and events[-1] - events[0] <= 1
    assert sp.assign_folds(made.limit(0), "person", "y", 4).count() == 0


def test_samples(rows):
    assert sp.sample_n(rows, "id", 50).count() == 50
    assert sp.sample_n(rows, "id", 5000).count() == 900
    assert sorted(r.id for r in sp.sample_n(rows, "id", 50).collect()) == sorted(r.id for r in sp.sample_n(rows.repartition(5), "id", 50).collect())
    assert [r.id for r in sp.head_n(rows, "id", 3).collect()] == [0, 1, 2]


def sizes(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_balance(rows):
    n = sizes(rows)
    assert sizes(sp.oversample(rows, "y", "id")) == {0: n[0], 1: n[0]}
    assert sizes(sp.undersample(rows, "y", "id")) == {0: n[1], 1: n[1]}
    assert sizes(sp.rebalance(rows.select("id", "x", "y"), "y", "id", "x", "smote")) == {0: n[0], 1: n[0]}
    assert sizes(sp.near_miss(rows, "y", "id", "x")) == {0: n[1], 1: n[1]}
    weighted = sp.rebalance(rows, "y", "id", "x", "class_weighting").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in weighted] == pytest.approx([450, 450])
    with pytest.raises(ValueError):
        sp.rebalance(rows, "y", "id", "x", "magic")


@pytest.mark.parametrize("block_rows", [7, 100, 20_000])
def test_nearest_is_exact(rows, block_rows):
    queries, points = rows.filter("id < 60"), rows.filter("id < 90 and id % 2 = 0")
    got = {}
    for r in sp.nearest(queries, points, 3, "id", "x", block_rows).orderBy("q_id", "place").collect():
        got.setdefault(r.q_id, []).append(r.p_id)
    p = [(r.id, np.array(r.x)) for r in points.collect()]
    for r in queries.collect():
        order = sorted((np.linalg.norm(np.array(r.x) - x), i) for i, x in p if i != r.id)
        assert got[r.id] == [i for _, i in order[:3]]


def test_nearest_among_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(99, [5.0, 5.0])], "id long, x array<double>")
    out = sp.nearest(df, df, 2, "id", "x", 10)
    assert out.filter("q_id = 0").orderBy("place").select("p_id", "distance").collect() == [(1, 0.0), (2, 0.0)]
    assert out.count() == 82


@pytest.mark.parametrize("pivots,block_rows", [(1, 7), (5, 20), (40, 1000)])
def test_nearest_equals_all_pairs(spark, pivots, block_rows):
    """Groups, copies, ties on a grid and a far point, for few and many cells and blocks."""
    draw = np.random.default_rng(pivots)
    x = np.concatenate([draw.integers(0, 3, (60, 2)), 50 + draw.normal(size=(60, 2)), [[1e6, -1e6], [0.1, 0.2], [0.1, 0.2]]]).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    queries, points = df.filter("id % 3 > 0"), df.filter("id % 2 = 0")
    want = []
    for q in range(len(x)):
        if q % 3 > 0:
            near = sorted((float(np.sqrt(((x[q] - x[p]) ** 2).sum())), p) for p in range(0, len(x), 2) if p != q)[:4]
            want += [(q, p, round(d, 9), i + 1) for i, (d, p) in enumerate(near)]
    out = sp.nearest(queries, points, 4, "id", "x", block_rows, pivots)
    assert sorted((r.q_id, r.p_id, round(r.distance, 9), r.place) for r in out.collect()) == sorted(want)


def test_nearest_of_few_or_no_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert [(r.q_id, r.p_id) for r in sp.nearest(df, df, 5, "id", "x").orderBy("q_id").collect()] == [(1, 2), (2, 1)]
    assert sp.nearest(df, df.limit(0), 5, "id", "x").collect() == []
    assert sp.nearest(df.limit(0), df, 5, "id", "x").collect() == []


def test_nearest_copies_a_query_once_per_block(spark, monkeypatch):
    """Distances all alike rule out no cell; yet a query does not come once per cell."""
    x = np.random.default_rng(5).normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    written, durable = {}, sp.durable

    def counted(rows, name):
        rows = durable(rows, name)
        met = F.sum(F.size("blocks")) if "blocks" in rows.columns else F.count(F.lit(1))
        written[name] = max(written.get(name, 0), rows.agg(met).first()[0] or 0)
        return rows

    monkeypatch.setattr(sp, "durable", counted)
    out = sp.nearest(df, df, 3, "id", "x", 300)
    assert out.count() == 2700
    # a block holds more than half of block_rows unless it is the last
    assert 0 < written["visits"] <= 900 * 6


@pytest.mark.parametrize("dims", [2, 40])
def test_closest_holds_bounded_arrays_where_distances_tie(monkeypatch, dims):
    monkeypatch.setattr(sp, "PAIRS", 20_000)
    turn = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    around = np.hstack([np.cos(turn)[:, None], np.sin(turn)[:, None], np.zeros((3000, dims - 2))])
    ps = pd.DataFrame({"p_id": np.arange(3000), "p_x": list(np.sign(around)), "cell": 0})
    qs = pd.DataFrame({"q_id": np.arange(10_000, 10_400), "q_x": list(np.zeros((400, dims))), "own": 0, "near": 0.0, "known": np.nan})
    pivots = np.zeros((1, dims))
    tracemalloc.start()
    out = sp._closest(2, pivots, np.asarray([2.0]), np.asarray([0.0]))(qs, ps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    least = np.sqrt((np.sign(around) ** 2).sum(axis=1))
    want = sorted(zip(least, range(3000), strict=True))[:2]
    assert out.groupby("q_id")["p_id"].apply(list).tolist() == [[i for _, i in want]] * 400
    assert peak < 12_000_000  # all pairs would take 9.6 MB per array of numbers, their differences dims times as much


def test_nearest_of_repeated_ids_and_many_copies(spark):
    """A query is not its own neighbour, however often its id comes; other ids with the same vector are."""
    rows = [(7, [1.0, 1.0])] * 9 + [(i, [1.0, 1.0]) for i in range(20, 60)] + [(8, [3.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    query = spark.createDataFrame([(7, [1.0, 1.0]), (20, [1.0, 1.0]), (8, [3.0, 1.0])], "id long, x array<double>")
    got = {}
    for r in sp.nearest(query, points, 3, "id", "x", 10).orderBy("q_id", "place").collect():
        got.setdefault(r.q_id, []).append((r.p_id, r.distance))
    assert got == {7: [(20, 0.0), (21, 0.0), (22, 0.0)], 20: [(7, 0.0)] * 3, 8: [(7, 2.0)] * 3}


def test_smote_lies_between_neighbours(rows):
    new = sp.smote(rows, "y", "id", "x").limit(50).collect()
    x = {r.id: np.array(r.x) for r in rows.collect()}
    for r in new:
        a, b = x[r.base_id], x[r.neighbour_id]
        assert np.allclose(r.x, a + r.gap * (b - a)) and 0 <= r.gap < 1


def test_density(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    df = spark.createDataFrame([("a", float(t)) for t in v], "g string, v double")
    out = dn.kde(df, ["g"], "v", 256).orderBy("v").collect()
    bw = 0.9 * min(v.std(ddof=1), np.subtract(*np.percentile(v, [75, 25])) / 1.34) * 500 ** -0.2
    grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 256)
    exact = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(axis=1)
    assert [r.v for r in out] == pytest.approx(list(grid))
    assert np.abs(np.array([r.dens for r in out]) - exact / exact.max()).max() < 2e-3


def test_density_of_a_constant(spark):
    df = spark.createDataFrame([("a", 0.0)] * 5, "g string, v double")
    out = dn.kde(df, ["g"], "v", 16).collect()
    assert max(r.dens for r in out) == 1.0 and len(out) == 16


def test_trend_of_a_straight_line(spark):
    df = spark.createDataFrame([("a", i / 100, 2 * i / 100 + 1) for i in range(1000)], "g string, x double, y double")
    for r in dn.trend(df, ["g"], "x", "y", 20).collect():
        assert r.y_smooth == pytest.approx(2 * r.x_mid + 1, abs=1e-6)


def test_local_regression_follows_parabolas_and_uses_the_nearest_share(spark):
    rows = [("p", i / 100, 3 + 2 * (i / 100) ** 2) for i in range(-200, 201)]
    rows += [("one", 5.0, float(i)) for i in range(4)] + [("two", float(i % 2), float(i % 2)) for i in range(6)]
    rows += [("step", i / 1000, 0.0) for i in range(1000)] + [("step", 1.0 + i, 1.0) for i in range(40)] + [("none", None, 1.0)]
    out = dn.local_regression(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()
    found = {}
    for r in out:
        found.setdefault(r.g, {})[r.bin] = (r.x_mid, r.y_smooth)
    assert set(found) == {"p", "one", "two", "step"}
    assert all(abs(y - (3 + 2 * x * x)) < 1e-6 for x, y in found["p"].values())
    assert found["one"] == {0: (5.0, 1.5)}
    assert len(found["two"]) == 2 and all(abs(y - x) < 1e-6 for x, y in found["two"].values())
    # the first bin alone holds the share of the rows, so nothing beyond it counts there
    assert found["step"][0][1] == 0.0


def test_local_regression_equals_a_weighted_fit(spark):
    draw = np.random.default_rng(2)
    x = np.sort(draw.exponential(size=400))
    y = np.sin(x) + 0.1 * draw.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    width = (x[-1] - x[0]) / 20
    bins = np.minimum(np.floor((x - x[0]) / width), 19)
    for r in dn.local_regression(df.withColumn("g", F.lit(1)), ["g"], "x", "y", 20, 0.6).collect():
        away = np.abs(bins - r.bin)
        reach = next(h for h in range(21) if (away <= h).sum() >= 0.6 * 400) + 1
        w = (1 - np.minimum(away / reach, 1) ** 3) ** 3
        u = (x - x[0]) / width - (r.bin + 0.5)
        fit = np.polynomial.polynomial.polyfit(u, y, 2, w=np.sqrt(w))
        assert abs(fit[0] - r.y_smooth) < 1e-6
