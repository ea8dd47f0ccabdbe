"""Queries for sorting, sampling, folds, class balance, imputation and densities."""

from pyspark.sql import functions as F

from episodica.operators import cohort as c
from episodica.operators import density as dn
from episodica.operators import sampling as sp
from episodica.plans import proxies as P
from episodica.plans.proxies import with_recursive, with_views
from episodica.plans.registry import query


def _u(key, seed):
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("multi_sort", "SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id")
def multi_sort(spark, sf):
    return P.table(spark, sf, "events").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id")


@query("top_k", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def top_k(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(
        F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10)


@query("custom_order", """SELECT event_type, row_number() OVER (ORDER BY first) AS place FROM (
    SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type) t""")
def custom_order(spark, sf):
    from pyspark.sql import Window as W

    firsts = P.table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return firsts.select("event_type", F.row_number().over(W.orderBy("first")).alias("place"))


@query("sample_seeded", "SELECT event_id, value FROM events ORDER BY md5(event_id || '|42'), event_id LIMIT 500")
def sample_seeded(spark, sf):
    return sp.sample_n(P.table(spark, sf, "events").select("event_id", "value"), "event_id", 500, 42)


@query("head_n", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def head_n(spark, sf):
    return sp.head_n(P.table(spark, sf, "events").select("event_id", "value"), "event_id", 100)


def impute_views(col, source):
    valid = f"SELECT hour({col}) AS h FROM {source} WHERE second({col}) <> 1"
    u = _u("admission_id", f"42{col}h")
    u1, u2 = _u("admission_id", f"42{col}na"), _u("admission_id", f"42{col}nb")
    return {
        f"{col}_valid": valid,
        f"{col}_cdf": f"SELECT h, sum(count(*)) OVER (ORDER BY h) AS upto FROM {col}_valid GROUP BY h",
        f"{col}_stat": f"""SELECT count(*) AS n, 0.9 * least(stddev_samp(h), (quantile_cont(h, 0.75) - quantile_cont(h, 0.25)) / 1.34)
            * pow(count(*), -0.2) AS bw FROM {col}_valid""",
        f"{col}_new": f"""SELECT admission_id, CASE WHEN second({col}) = 1 THEN {col} + to_hours(CAST(least(23, greatest(0,
            round_even((SELECT min(h) FROM {col}_cdf WHERE upto > {u} * n) + sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2}) * bw, 0)))
            - hour({col}) AS BIGINT)) ELSE {col} END AS {col} FROM {source}, {col}_stat""",
    }


@query("impute_hours", with_views("""SELECT admission_id, admission_datetime, discharge_datetime
    FROM admission_datetime_new JOIN discharge_datetime_new USING (admission_id)""", "stays",
    **impute_views("admission_datetime", "stays"), **impute_views("discharge_datetime", "stays")))
def impute_hours(spark, sf):
    stays = P.stays(spark, sf).drop("person_id")
    for col in ("admission_datetime", "discharge_datetime"):
        stays = c.impute_hours(stays, col, "admission_id", 42)
    return stays


FOLDS = """SELECT p.id, p.person_id, p.y_true, s.fold FROM predictions p JOIN (SELECT *, row_number() OVER (
    PARTITION BY e, o ORDER BY md5(person_id || '|42'), person_id) AS pos FROM persons) g USING (person_id)
    JOIN runs r ON r.e = g.e AND r.o = g.o JOIN steps s ON s.run = r.run AND s.upto >= pos AND s.upto - s.block < pos"""
PERSONS = """SELECT person_id, sum(y_true)::BIGINT AS e, sum(1 - y_true)::BIGINT AS o FROM predictions GROUP BY person_id"""
RUNS = """SELECT *, row_number() OVER (ORDER BY abs(e - o) DESC, e DESC) AS run, greatest(1, sum(e * m) OVER ())::BIGINT AS n1,
    greatest(1, sum(o * m) OVER ())::BIGINT AS n0 FROM (SELECT e, o, count(*) AS m FROM persons GROUP BY e, o) c"""
# every step tries one block of equal persons in each of 5 folds
STEPS = """SELECT 0::BIGINT AS run, 0::BIGINT AS m, 0::BIGINT AS upto, 0::BIGINT AS block, NULL::INT AS fold,
        [0, 0, 0, 0, 0]::BIGINT[] AS es, [0, 0, 0, 0, 0]::BIGINT[] AS os
    UNION ALL SELECT run, m, upto + block, block, fold, es, os FROM (SELECT *, row_number() OVER (ORDER BY
        sqrt((5 * list_sum(list_transform(es, lambda v: v * v)) - list_sum(es) ** 2)::DOUBLE) / n1
        + sqrt((5 * list_sum(list_transform(os, lambda v: v * v)) - list_sum(os) ** 2)::DOUBLE) / n0, fold) AS place FROM (
        SELECT r.run, r.m, r.n1, r.n0, i.done AS upto, i.block, f.fold::INT AS fold,
            list_transform(i.es, lambda v, j: v + CASE WHEN j = f.fold + 1 THEN i.block * r.e ELSE 0 END) AS es,
            list_transform(i.os, lambda v, j: v + CASE WHEN j = f.fold + 1 THEN i.block * r.o ELSE 0 END) AS os
        FROM (SELECT c.next_run, c.done, c.es, c.os, greatest(1, (q.m - c.done) // 80) AS block FROM (
            SELECT CASE WHEN upto < m THEN run ELSE run + 1 END AS next_run, CASE WHEN upto < m THEN upto ELSE 0 END AS done, es, os
            FROM steps) c JOIN runs q ON q.run = c.next_run) i
        JOIN runs r ON r.run = i.next_run, range(5) f(fold)) tried) ranked WHERE place = 1"""


@query("stratified_group_folds", with_recursive(FOLDS, "predictions", persons=PERSONS, runs=RUNS, steps=STEPS))
def stratified_group_folds(spark, sf):
    preds = P.predictions(spark, sf).select("id", "person_id", "y_true")
    return sp.assign_folds(preds, "person_id", "y_true", 5, 42)


@query("class_weights", with_views("""SELECT id, y_true, round(n / (2.0 * c), 6) AS weight FROM predictions
    JOIN (SELECT y_true, count(*) AS c FROM predictions GROUP BY y_true) k USING (y_true), (SELECT count(*) AS n FROM predictions)""",
    "predictions"))
def class_weights(spark, sf):
    out = sp.class_weights(P.predictions(spark, sf).select("id", "y_true"), "y_true")
    return out.withColumn("weight", F.round("weight", 6))


SIZES = "SELECT count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0 FROM predictions"
RANKS = "SELECT id, row_number() OVER (ORDER BY md5(id || '|42')) AS rank FROM predictions WHERE y_true = {}"


@query("random_over", with_views(f"""SELECT id, y_true, count(*) AS copies FROM (SELECT id, y_true FROM predictions
    UNION ALL SELECT r.id, 1 FROM (SELECT 1 + CAST(floor({_u('draw', '42row')} * n1) AS BIGINT) AS rank
    FROM (SELECT unnest(range(1, n0 - n1 + 1)) AS draw, n1 FROM sizes) x) d JOIN ranks r USING (rank)) t GROUP BY id, y_true""",
    "predictions", sizes=SIZES, ranks=RANKS.format(1)))
def random_over(spark, sf):
    out = sp.oversample(P.predictions(spark, sf).select("id", "y_true"), "y_true", "id")
    return out.groupBy("id", "y_true").agg(F.count(F.lit(1)).alias("copies"))


@query("random_under", with_views("""SELECT id, y_true FROM predictions WHERE y_true = 1 UNION ALL
    SELECT id, 0 FROM ranks, sizes WHERE rank <= n1""", "predictions", sizes=SIZES, ranks=RANKS.format(0)))
def random_under(spark, sf):
    return sp.undersample(P.predictions(spark, sf).select("id", "y_true"), "y_true", "id")


# Labels below 3 make a clearly smaller class than the even split of the vectors view.
RARE = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y FROM embeddings"
DIST = """SELECT a.id AS q_id, b.id AS p_id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS place,
    list_distance(a.x, b.x) AS distance FROM rare a JOIN rare b ON a.id <> b.id AND b.y = 1 AND a.y = {}"""


def rare_vectors(spark, sf):
    return P.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 3).cast("int").alias("y"))


@query("near_miss", with_views("""SELECT id, y FROM rare WHERE y = 1 UNION ALL SELECT q_id, 0 FROM (
    SELECT q_id, row_number() OVER (ORDER BY avg(distance), q_id) AS rn FROM dist WHERE place <= 5 GROUP BY q_id) t
    WHERE rn <= (SELECT count(*) FROM rare WHERE y = 1)""", rare=RARE, dist=DIST.format(0)))
def near_miss(spark, sf):
    return sp.near_miss(rare_vectors(spark, sf), "y", "id", "x").select("id", "y")


@query("smote", with_views(f"""SELECT draw, base_id, p_id AS neighbour_id, round(gap, 6) AS gap,
    round(list_sum(b.x) + gap * (list_sum(o.x) - list_sum(b.x)), 6) AS x_sum FROM (
    SELECT draw, {_u('draw', '42gap')} AS gap, 1 + CAST(floor({_u('draw', '42row')} * n1) AS BIGINT) AS rank,
    1 + CAST(floor({_u('draw', '42neighbour')} * 5) AS BIGINT) AS place FROM (SELECT unnest(range(1, n0 - n1 + 1)) AS draw, n1
    FROM (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM rare)) x) d
    JOIN (SELECT id AS base_id, row_number() OVER (ORDER BY md5(id || '|42')) AS rank FROM rare WHERE y = 1) r USING (rank)
    JOIN dist n ON n.q_id = base_id AND n.place = d.place JOIN rare b ON b.id = base_id JOIN rare o ON o.id = p_id""",
    rare=RARE, dist=DIST.format(1)))
def smote(spark, sf):
    out = sp.smote(rare_vectors(spark, sf), "y", "id", "x")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return out.select("draw", "base_id", "neighbour_id", F.round("gap", 6).alias("gap"), F.round(total, 6).alias("x_sum"))


@query("class_handling", with_views("""SELECT 'none' AS how, y_true, count(*) AS n, round(sum(1.0), 3) AS total FROM predictions GROUP BY y_true
    UNION ALL SELECT 'class_weighting', y_true, count(*), round(n / 2.0, 3) FROM predictions, (SELECT count(*) AS n FROM predictions) x GROUP BY y_true, n
    UNION ALL SELECT 'random_over', y, n0, n0 FROM sizes, (VALUES (0), (1)) v(y)
    UNION ALL SELECT 'random_under', y, n1, n1 FROM sizes, (VALUES (0), (1)) v(y)
    UNION ALL SELECT how, y, n, n FROM (SELECT 'near_miss' AS how, count(*) FILTER (y = 1) AS n FROM rare
    UNION ALL SELECT 'smote', count(*) FILTER (y = 0) FROM rare) r, (VALUES (0), (1)) v(y)""", "predictions", sizes=SIZES, rare=RARE))
def class_handling(spark, sf):
    from episodica.operators.reshape import union_with_label

    preds = P.predictions(spark, sf).select("id", F.col("y_pred").alias("x"), "y_true")
    frames = {how: sp.rebalance(preds, "y_true", "id", "x", how) for how in ("none", "class_weighting", "random_over", "random_under")}
    vectors = rare_vectors(spark, sf).withColumnRenamed("y", "y_true")
    for how in ("near_miss", "smote"):  # both need vectors and a class that is clearly smaller
        frames[how] = sp.rebalance(vectors, "y_true", "id", "x", how).select("id", F.lit(0.0).alias("x"), "y_true", "weight")
    frames = {how: df.select("id", "x", "y_true", "weight") for how, df in frames.items()}
    return union_with_label(frames, "how").groupBy("how", "y_true").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("total"))


N_GRID = 512


@query("density_grid", with_views(f"""SELECT dataset, place, round(raw / max(raw) OVER (PARTITION BY dataset), 6) AS dens FROM (
    SELECT dataset, g AS place, sum(w * exp(-0.5 * pow((g - i) * step / bw, 2))) AS raw
    FROM weights JOIN grid USING (dataset), range({N_GRID}) t(g) GROUP BY dataset, g) r""", "predictions",
    stats="""SELECT dataset, min(y_pred) AS lo, max(y_pred) AS hi, 0.9 * least(stddev_samp(y_pred), (quantile_cont(y_pred, 0.75)
        - quantile_cont(y_pred, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM predictions GROUP BY dataset""",
    grid=f"SELECT dataset, bw, lo - 3 * bw AS g_lo, (hi - lo + 6 * bw) / {N_GRID - 1} AS step FROM stats",
    place=f"SELECT dataset, (y_pred - g_lo) / step AS pos, least(floor((y_pred - g_lo) / step), {N_GRID - 2}) AS below FROM predictions JOIN grid USING (dataset)",
    weights="""SELECT dataset, i, sum(w) AS w FROM (SELECT dataset, below AS i, 1 - (pos - below) AS w FROM place
        UNION ALL SELECT dataset, below + 1, pos - below FROM place) s GROUP BY dataset, i"""))
def density_grid(spark, sf):
    from pyspark.sql import Window as W

    out = dn.kde(P.predictions(spark, sf), ["dataset"], "y_pred", N_GRID)
    place = F.row_number().over(W.partitionBy("dataset").orderBy("y_pred")) - 1
    return out.select("dataset", place.alias("place"), F.round("dens", 6).alias("dens"))


N_TREND = 20
TREND_W = f"pow(1 - pow(least(abs(c.b - t.b) / {0.75 * N_TREND / 2 + 1e-9}, 1), 3), 3)"


@query("binned_trend", with_views("""SELECT dataset, bin, round((sy - slope * sx) / sn + slope * x_mid, 6) AS y_smooth FROM (
    SELECT *, (sn * sxy - sx * sy) / (sn * sxx - sx * sx) AS slope FROM fits) f""", "predictions",
    ends="SELECT dataset, min(y_pred) AS lo, max(y_pred) AS hi FROM predictions GROUP BY dataset",
    bins=f"""SELECT dataset, least(floor((y_pred - lo) / ((hi - lo) / {N_TREND})), {N_TREND - 1}) AS b, count(*)::DOUBLE AS n,
        sum(y_pred) AS x, sum(y_true) AS y, sum(y_pred * y_pred) AS xx, sum(y_pred * y_true) AS xy
        FROM predictions JOIN ends USING (dataset) GROUP BY dataset, b""",
    fits=f"""SELECT t.dataset, t.b AS bin, any_value(lo + (t.b + 0.5) * (hi - lo) / {N_TREND}) AS x_mid,
        sum({TREND_W} * c.n) AS sn, sum({TREND_W} * c.x) AS sx, sum({TREND_W} * c.y) AS sy, sum({TREND_W} * c.xx) AS sxx,
        sum({TREND_W} * c.xy) AS sxy FROM bins t JOIN bins c USING (dataset) JOIN ends USING (dataset) GROUP BY t.dataset, t.b"""))
def binned_trend(spark, sf):
    out = dn.trend(P.predictions(spark, sf), ["dataset"], "y_pred", "y_true", N_TREND)
    return out.select("dataset", "bin", F.round("y_smooth", 6).alias("y_smooth"))


#: A skewed column: most rows lie near 0, so that the window around a bin is narrow there and wide at the other end.
LOESS = dict(
    points="SELECT dataset, pow(y_pred, 4) AS x, CAST(y_true AS DOUBLE) AS y FROM predictions WHERE y_pred IS NOT NULL AND y_true IS NOT NULL",
    span="SELECT dataset, min(x) AS lo, (max(x) - min(x)) / 50 AS width FROM points GROUP BY dataset",
    place="SELECT dataset, y, (x - lo) / width AS u, least(floor((x - lo) / width), 49) AS b FROM points JOIN span USING (dataset)",
    bins="""SELECT dataset, b, count(*) AS n, sum(u - b - 0.5) AS s1, sum(pow(u - b - 0.5, 2)) AS s2, sum(pow(u - b - 0.5, 3)) AS s3,
        sum(pow(u - b - 0.5, 4)) AS s4, sum(y) AS t0, sum(y * (u - b - 0.5)) AS t1, sum(y * pow(u - b - 0.5, 2)) AS t2 FROM place GROUP BY dataset, b""",
    pairs="SELECT o.dataset, o.b AS bin, c.b - o.b AS d, c.* EXCLUDE (dataset, b) FROM bins o JOIN bins c USING (dataset)",
    held="SELECT dataset, bin, abs(d) AS d, sum(n) OVER (PARTITION BY dataset, bin ORDER BY abs(d)) AS n, sum(n) OVER (PARTITION BY dataset, bin) AS rows FROM pairs",
    reach="SELECT dataset, bin, min(d) + 1 AS r FROM held WHERE n >= 0.75 * rows GROUP BY dataset, bin",
    fits="""SELECT dataset, bin, sum(w * n) AS a0, sum(w * (s1 + d * n)) AS a1, sum(w * (s2 + 2 * d * s1 + d * d * n)) AS a2,
        sum(w * (s3 + 3 * d * s2 + 3 * d * d * s1 + pow(d, 3) * n)) AS a3,
        sum(w * (s4 + 4 * d * s3 + 6 * d * d * s2 + 4 * pow(d, 3) * s1 + pow(d, 4) * n)) AS a4, sum(w * t0) AS y0,
        sum(w * (t1 + d * t0)) AS y1, sum(w * (t2 + 2 * d * t1 + d * d * t0)) AS y2
        FROM (SELECT *, pow(1 - pow(least(abs(d) / r, 1), 3), 3) AS w FROM pairs JOIN reach USING (dataset, bin)) p GROUP BY dataset, bin""",
)


@query("local_regression", with_views("""SELECT dataset, CAST(bin AS INTEGER) AS bin, round(lo + (bin + 0.5) * width, 6) AS x_mid, round(
    CASE WHEN a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2) > 1e-9 * a0 * a2 * a4
    THEN (y0 * (a2 * a4 - a3 * a3) - a1 * (y1 * a4 - a3 * y2) + a2 * (y1 * a3 - a2 * y2))
    / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2))
    WHEN a0 * a2 - a1 * a1 > 1e-9 * a0 * a2 THEN (y0 * a2 - a1 * y1) / (a0 * a2 - a1 * a1) ELSE y0 / a0 END, 6) AS y_smooth
    FROM fits JOIN span USING (dataset)""", "predictions", **LOESS))
def local_regression(spark, sf):
    skewed = P.predictions(spark, sf).withColumn("x", F.pow("y_pred", F.lit(4.0)))
    out = dn.local_regression(skewed, ["dataset"], "x", "y_true")
    return out.withColumns({c: F.round(c, 6) for c in ("x_mid", "y_smooth")})
