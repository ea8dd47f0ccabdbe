"""Kernel densities and smoothed trends from binned data.

Rows are reduced to weights on a grid first; everything after that has the size of the grid, not of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.quantiles import exact_quantiles
from episodica.session import durable


def bandwidths(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Per group: range, rows and the bandwidth 0.9 * min(sd, IQR / 1.34) * n^(-1/5)."""
    by = list(by)
    moments = df.groupBy(*by).agg(
        F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"), F.stddev_samp(col).alias("sd")
    )
    quartiles = exact_quantiles(df, by, col, {"q1": 0.25, "q3": 0.75})
    joined = moments.join(quartiles, by)
    robust = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    spread = F.when(robust > 0, robust).when(F.col("sd") > 0, F.col("sd")).when(F.col("lo") != 0, F.abs("lo")).otherwise(F.lit(1.0))
    return joined.select(*by, "lo", "hi", "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def kde(
    df: DataFrame, by: Sequence[str], col: str, n: int = 512, limits: Sequence[str] | None = None, min_dens: float = 0.0
) -> DataFrame:
    """Gaussian kernel density on n equally spaced points per group, scaled to a maximum of 1.

    The grid runs three bandwidths beyond the data, or between the columns named in `limits` (constant per group). Each
    row's weight is shared between its two neighbouring grid points; the kernel then runs over at most n weights per
    grid point.
    """
    by = list(by)
    stats = bandwidths(df, by, col)
    bw, reach = F.col("bw").alias("_bw"), 3 * F.col("bw")
    if limits is None:
        grid = stats.select(*by, bw, (F.col("lo") - reach).alias("_from"), (F.col("hi") + reach).alias("_to"))
    else:
        ends = df.groupBy(*by).agg(F.min(limits[0]).alias("_from"), F.max(limits[1]).alias("_to"))
        grid = stats.select(*by, bw).join(ends, by)
    grid = durable(grid.withColumn("_step", (F.col("_to") - F.col("_from")) / (n - 1)), "grid")
    at = F.when(F.col("_step") > 0, (F.col(col) - F.col("_from")) / F.col("_step")).otherwise(F.lit(0.0))
    below = F.least(F.floor(at), F.lit(n - 2))
    shares = F.array(
        F.struct(below.cast("int").alias("i"), (1 - (at - below)).alias("w")),
        F.struct((below + 1).cast("int").alias("i"), (at - below).alias("w")),
    )
    weights = (
        df.select(*by, col)
        .join(grid, by)
        .select(*by, F.explode(shares).alias("_share"))
        .groupBy(*by, F.col("_share.i").alias("_i"))
        .agg(F.sum("_share.w").alias("_w"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_w").alias("w")))).alias("_cells"))
    )
    points = weights.join(grid, by).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    scale = F.col("_step") / F.col("_bw")

    def add(total, cell):
        u = (F.col("_g") - cell["i"]) * scale
        return total + cell["w"] * F.exp(-0.5 * u * u)

    raw = points.select(
        *by,
        (F.col("_from") + F.col("_g") * F.col("_step")).alias(col),
        F.aggregate("_cells", F.lit(0.0), add).alias("_raw"),
    )
    raw = durable(raw, "density")
    peaks = raw.groupBy(*by).agg(F.max("_raw").alias("_peak"))
    scaled = raw.join(peaks, by).select(*by, col, (F.col("_raw") / F.col("_peak")).alias("dens"))
    return scaled.filter(F.col("dens") >= min_dens) if min_dens > 0 else scaled


def trend(df: DataFrame, by: Sequence[str], x: str, y: str, n: int = 50, span: float = 0.75) -> DataFrame:
    """Local linear trend of y over x on n bins per group, with tricube weights over `span` of the range.

    Each bin keeps the sums (n, x, y, xx, xy); the weighted straight line through neighbouring bins has a closed form.
    """
    by = list(by)
    ends = durable(df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")), "ends")
    width = (F.col("_hi") - F.col("_lo")) / n
    at = F.when(width > 0, F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(n - 1))).otherwise(F.lit(0))
    bins = (
        df.join(ends, by)
        .groupBy(*by, at.cast("int").alias("_b"))
        .agg(
            F.struct(
                F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).cast("double").alias("x"),
                F.sum(y).cast("double").alias("y"), F.sum(F.col(x) * F.col(x)).cast("double").alias("xx"),
                F.sum(F.col(x) * F.col(y)).cast("double").alias("xy"),
            ).alias("_sums")
        )
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("_b", "_sums"))).alias("_bins"))
    )
    reach = span * n / 2 + 1e-9
    spread = bins.join(ends, by).withColumn("bin", F.explode(F.transform("_bins", lambda c: c["_b"])))

    def add(total, c):
        d = F.least(F.abs(c["_b"] - F.col("bin")) / F.lit(reach), F.lit(1.0))
        w = F.pow(1 - F.pow(d, F.lit(3.0)), F.lit(3.0))
        return F.struct(*[(total[k] + w * c["_sums"][k]).alias(k) for k in ("n", "x", "y", "xx", "xy")])

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")])
    sums = spread.withColumn("_fit", F.aggregate("_bins", zero, add))
    s = {k: F.col(f"_fit.{k}") for k in ("n", "x", "y", "xx", "xy")}
    middle = F.col("_lo") + (F.col("bin") + 0.5) * width
    spread_x = s["n"] * s["xx"] - s["x"] * s["x"]
    slope = F.when(spread_x > 1e-12 * s["n"] * s["xx"], (s["n"] * s["xy"] - s["x"] * s["y"]) / spread_x).otherwise(F.lit(0.0))
    level = (s["y"] - slope * s["x"]) / s["n"]
    return sums.select(*by, "bin", middle.alias("x_mid"), (level + slope * middle).alias("y_smooth"))


def local_regression(df: DataFrame, by: Sequence[str], x: str, y: str, n: int = 50, span: float = 0.75) -> DataFrame:
    """(by, bin, x_mid, y_smooth): local regression of degree 2, over the nearest `span` of the rows around every bin.

    A group is reduced to n bins of equal width, each with the moments of its rows about the middle of the bin. Around a
    bin the window grows until it holds the share `span` of all rows of the group (whole bins, both sides alike), so that
    it is wide where rows are sparse; rows weigh by the tricube of the distance of their bin. Moments move from bin to
    bin by the binomial rule, which is exact, and the weighted parabola has a closed form. Where the window has too few
    different values for it, a straight line is fitted, and where it has one value, the mean. Rows without x or y are
    left out; a group of a single x is one bin. Only bins that have rows are returned.
    """
    by = list(by)
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = durable(df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")), "ends")
    width = (F.col("_hi") - F.col("_lo")) / n
    place = F.when(width > 0, (F.col(x) - F.col("_lo")) / width).otherwise(F.lit(0.5))
    placed = df.join(ends, by).withColumn("_u", place).withColumn("_b", F.least(F.floor("_u"), F.lit(n - 1)).cast("int"))
    v, value = F.col("_u") - F.col("_b") - 0.5, F.col(y).cast("double")
    power = lambda k: F.pow(v, F.lit(float(k))) if k else F.lit(1.0)
    moments = [F.sum(power(k)).alias(f"s{k}") for k in range(5)] + [F.sum(power(k) * value).alias(f"t{k}") for k in range(3)]
    bins = durable(placed.groupBy(*by, "_b").agg(*moments), "bins")
    cells = bins.groupBy(*by).agg(F.collect_list(F.struct("_b", *[f"s{k}" for k in range(5)], *[f"t{k}" for k in range(3)])).alias("_cells"))
    around = bins.select(*by, F.col("_b").alias("bin")).join(cells, by)

    nearer = F.array_sort(F.transform("_cells", lambda c: F.struct(F.abs(c["_b"] - F.col("bin")).alias("d"), c["s0"].alias("n"))))
    enough = F.aggregate("_cells", F.lit(0.0), lambda a, c: a + c["s0"]) * span
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0).alias("d"))
    grown = F.aggregate(nearer, start, lambda a, c: F.when(a["n"] >= enough, a).otherwise(F.struct((a["n"] + c["n"]).alias("n"), c["d"].alias("d"))))
    around = around.withColumn("_reach", grown["d"] + 1)

    def moved(c, kind: str, k: int, shift):
        terms = [math.comb(k, j) * F.pow(shift, F.lit(float(k - j))) * c[f"{kind}{j}"] for j in range(k)]
        return sum(terms, c[f"{kind}{k}"])

    def add(total, c):
        shift = (c["_b"] - F.col("bin")).cast("double")
        w = F.pow(1 - F.pow(F.least(F.abs(shift) / F.col("_reach"), F.lit(1.0)), F.lit(3.0)), F.lit(3.0))
        sums = [(total[f"s{k}"] + w * moved(c, "s", k, shift)).alias(f"s{k}") for k in range(5)]
        return F.struct(*sums, *[(total[f"t{k}"] + w * moved(c, "t", k, shift)).alias(f"t{k}") for k in range(3)])

    zero = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(5)], *[F.lit(0.0).alias(f"t{k}") for k in range(3)])
    fits = durable(around.withColumn("_fit", F.aggregate("_cells", zero, add)).select(*by, "bin", "_fit.*"), "fits")
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]
    minor = s[2] * s[4] - s[3] * s[3]
    whole = s[0] * minor - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    parabola = (t[0] * minor - s[1] * (t[1] * s[4] - s[3] * t[2]) + s[2] * (t[1] * s[3] - s[2] * t[2])) / whole
    flat = s[0] * s[2] - s[1] * s[1]
    line = (t[0] * s[2] - s[1] * t[1]) / flat
    level = (
        F.when(whole > 1e-9 * s[0] * s[2] * s[4], parabola).when(flat > 1e-9 * s[0] * s[2], line).otherwise(t[0] / s[0])
    )
    middle = F.when(width > 0, F.col("_lo") + (F.col("bin") + 0.5) * width).otherwise(F.col("_lo"))
    return fits.join(ends, by).select(*by, "bin", middle.alias("x_mid"), level.alias("y_smooth"))
