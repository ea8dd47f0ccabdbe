"""Many penalised logistic models fitted together: one scan of the rows serves all settings of an iteration.

Every row is stored once, with its weight in each training set (a fold left out, a way of class handling). In an iteration
a task adds up, for every setting not yet at its minimum, the gradient and the curvature of the weighted loss; the sums of
a setting meet in one group, which solves for the Newton step. Only coefficients reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.sampling import class_weights, rebalance, smote
from episodica.session import durable

#: Bytes of sums that a task may hold: settings are fitted in blocks that keep to it.
BLOCK_BYTES = 64 << 20
#: A fit ends when its next step would lower the mean loss by less than this.
TOLERANCE = 1e-11
SUMS = "setting int, sums binary"
STEPS = "setting int, loss double, gain double, step binary"


def training_rows(dev: DataFrame, y: str, key: str, fold: str, cells: Sequence[tuple[int, str]], seed: object = 42, parallelism: int = 8) -> DataFrame:
    """(x, y, fold, weights): every row once, weights[i] being its weight in training set i of cells, (fold left out, way).

    Weights that follow from fold and class are expressions; those of samplers are counted per key and joined. Synthetic
    rows have no fold, and a weight in their own training set only. Rows without fold or class are left out.
    """
    dev = durable(dev.filter(F.col(fold).isNotNull() & F.col(y).isNotNull()).select(key, "x", y, fold), "dev")

    def cell_weights(i: int) -> tuple[Column, DataFrame | None, DataFrame | None]:
        """Weight of a row inside cell i, the weights picked per key, the rows made."""
        left_out, how = cells[i]
        train = dev.filter(F.col(fold) != left_out).select(key, "x", y)
        if how == "none":
            return F.lit(1.0), None, None
        if how == "class_weighting":
            own = F.lit(0.0)
            for r in class_weights(train.select(y), y).distinct().collect():
                own = F.when(F.col(y) == r[y], F.lit(float(r["weight"]))).otherwise(own)
            return own, None, None
        if how == "smote":
            alone = F.array(*[F.lit(float(i == j)) for j in range(len(cells))])
            new = smote(train, y, key, "x", seed=seed)
            return F.lit(1.0), None, durable(new.select("x", y, F.lit(None).cast("int").alias(fold), alone.alias("weights")), "made")
        counts = rebalance(train, y, key, "x", how, seed).groupBy(key).agg(F.sum("weight").alias("weight"))
        own = F.coalesce(F.try_element_at("_picked", F.lit(i)), F.lit(0.0))
        return own, durable(counts.select(key, F.lit(i).alias("cell"), "weight"), "picked"), None

    # samplers are many small jobs: those of several training sets run side by side
    with ThreadPoolExecutor(parallelism) as pool:
        told = list(pool.map(cell_weights, range(len(cells))))
    weights = [F.when(F.col(fold) != left_out, own).otherwise(0.0) for (left_out, _), (own, _, _) in zip(cells, told, strict=True)]
    picked = [p for _, p, _ in told if p is not None]
    made = [m for *_, m in told if m is not None]
    if picked:
        together = picked[0]
        for part in picked[1:]:
            together = together.unionByName(part)
        # at most one entry per training set
        entries = F.collect_list(F.struct("cell", "weight"))
        dev = dev.join(together.groupBy(key).agg(F.map_from_entries(entries).alias("_picked")), key, "left")
    rows = dev.select("x", y, fold, F.array(*weights).alias("weights"))
    for part in made:
        rows = rows.unionByName(part)
    return durable(rows.withColumnRenamed(y, "y").withColumnRenamed(fold, "fold"), "training")


def _batch(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features with a one in front, and classes."""
    x = np.stack(frame["x"].to_numpy())
    return np.hstack([np.ones((len(x), 1)), x]), frame["y"].to_numpy(dtype=float)


def _log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z) - y * z


def _sums(cell: np.ndarray, coefficients: np.ndarray):
    """Per setting: weight, loss, gradient and upper half of the curvature, added up over a task's rows."""
    size = coefficients.shape[1]
    upper = np.triu_indices(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cell), 2 + size + len(upper[0])))
        for frame in frames:
            if frame.empty:
                continue
            x, y = _batch(frame)
            weights = np.stack(frame["weights"].to_numpy())
            for c in np.unique(cell):
                use = weights[:, c] > 0
                if not use.any():
                    continue
                rows, labels, w = x[use], y[use], weights[use, c]
                for s in np.flatnonzero(cell == c):
                    z = rows @ coefficients[s]
                    p = 0.5 * (1 + np.tanh(z / 2))
                    total[s, 0] += w.sum()
                    total[s, 1] += w @ _log_loss(z, labels)
                    total[s, 2 : 2 + size] += rows.T @ (w * (p - labels))
                    total[s, 2 + size :] += (rows.T @ (rows * (w * p * (1 - p))[:, None]))[upper]
        yield pd.DataFrame({"setting": np.arange(len(cell), dtype=np.int32), "sums": [t.tobytes() for t in total]})

    return run


def _newton(penalty: np.ndarray, coefficients: np.ndarray):
    """The Newton step of one setting from the sums of all tasks. penalty multiplies the squares of all but the constant."""
    size = coefficients.shape[1]
    upper = np.triu_indices(size)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["setting"].iloc[0])
        total = np.sum([np.frombuffer(b) for b in frame["sums"]], axis=0)
        b = coefficients[s].copy()
        b[0] = 0.0
        weight = total[0] or 1.0
        loss = total[1] / weight + penalty[s] * (b @ b)
        slope = total[2 : 2 + size] / weight + 2 * penalty[s] * b
        curve = np.zeros((size, size))
        curve[upper] = total[2 + size :] / weight
        curve += np.triu(curve, 1).T
        curve[np.arange(1, size), np.arange(1, size)] += 2 * penalty[s]
        step = -np.linalg.lstsq(curve, slope, rcond=1e-13)[0]
        return pd.DataFrame({"setting": [s], "loss": [loss], "gain": [-(slope @ step) / 2], "step": [step.tobytes()]})

    return run


def _scan(rows: DataFrame, cell: np.ndarray, penalty: np.ndarray, coefficients: np.ndarray) -> pd.DataFrame:
    """One pass over the rows: loss, expected gain and Newton step per setting. A group holds one row per task."""
    sums = rows.select("x", "y", "weights").mapInPandas(_sums(cell, coefficients), SUMS)
    return sums.groupBy("setting").applyInPandas(_newton(penalty, coefficients), STEPS).toPandas().set_index("setting")


def fit_together(rows: DataFrame, cell: Sequence[int], penalty: Sequence[float], max_iter: int = 50) -> tuple[np.ndarray, int]:
    """Coefficients (constant first) of one L2-penalised logistic model per setting, and the number of scans.

    rows as from training_rows; setting s is fitted to weights[cell[s]] with penalty[s]. A step that does not lower the
    loss is halved. Settings at their minimum drop out of the next scan. All-null or empty input: zeros.
    """
    cell, penalty = np.asarray(cell, dtype=np.int64), np.asarray(penalty, dtype=float)
    some = rows.select(F.size("x").alias("n")).first()
    size = 1 + (some["n"] if some else 0)
    fitted, scans = np.zeros((len(cell), size)), 0
    # sums of a task are rows of a shuffle: not more tasks than run at a time, a few times over
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    block = max(1, BLOCK_BYTES // (4 * size * (size + 1)))
    for first in range(0, len(cell), block) if some else ():
        active = np.arange(first, min(first + block, len(cell)))
        last = {s: (np.inf, fitted[s].copy(), np.zeros(size)) for s in active}
        for _ in range(max_iter):
            found = _scan(rows, cell[active], penalty[active], fitted[active])
            scans += 1
            going = []
            for i, s in enumerate(active):
                loss, gain, step = found.loc[i, "loss"], found.loc[i, "gain"], np.frombuffer(found.loc[i, "step"])
                before, at, tried = last[s]
                if loss > before + 1e-12:
                    tried = tried / 2
                    last[s] = (before, at, tried)
                    fitted[s] = at + tried
                    going.append(s)
                elif gain > TOLERANCE:
                    last[s] = (loss, fitted[s].copy(), step)
                    fitted[s] = fitted[s] + step
                    going.append(s)
            active = np.asarray(going, dtype=np.int64)
            if not len(active):
                break
    return fitted, scans


def held_out(dev: DataFrame, y: str, fold: str, left_out: Sequence[int], coefficients: np.ndarray) -> DataFrame:
    """(setting, loss, accuracy): every model on the rows of the fold it has not seen, in one scan."""
    places = np.asarray(left_out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(places), 3))
        for frame in frames:
            if frame.empty:
                continue
            x, labels = _batch(frame)
            for f in np.unique(places):
                own, of = frame["fold"].to_numpy() == f, np.flatnonzero(places == f)
                z = x[own] @ coefficients[of].T
                t = labels[own][:, None]
                total[of, 0] += own.sum()
                p = np.clip(0.5 * (1 + np.tanh(z / 2)), 1e-7, 1 - 1e-7)
                total[of, 1] -= np.log(np.where(t == 1, p, 1 - p)).sum(axis=0)
                total[of, 2] += ((z > 0) == (t == 1)).sum(axis=0)
        yield pd.DataFrame({"setting": np.arange(len(places), dtype=np.int32), "n": total[:, 0], "loss": total[:, 1], "hits": total[:, 2]})

    rows = dev.filter(F.col(fold).isNotNull() & F.col(y).isNotNull()).select("x", F.col(y).alias("y"), F.col(fold).alias("fold"))
    sums = rows.mapInPandas(run, "setting int, n double, loss double, hits double").groupBy("setting")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("n", "loss", "hits")])
    return sums.select("setting", F.try_divide("loss", "n").alias("loss"), F.try_divide("hits", "n").alias("accuracy"))


def cross_validated(dev: DataFrame, trials: Sequence[Mapping], y: str, key: str, fold: str, seed: object = 42, max_iter: int = 50):
    """(trial number, fold, loss, accuracy) of every trial on every fold, from shared scans.

    Trials with the same penalty and class handling are one fit. Returns (rows of the driver, number of scans)."""
    folds = sorted(r[0] for r in dev.select(fold).filter(F.col(fold).isNotNull()).distinct().collect())
    ways = sorted({t.get("class_handling", "none") for t in trials})
    cells = [(f, how) for f in folds for how in ways]
    kinds = sorted({(float(t.get("l2_penalty", 0.0)), t.get("class_handling", "none")) for t in trials})
    settings = [(f, l2, how) for f in folds for l2, how in kinds]
    if not settings:
        return [], 0
    rows = training_rows(dev, y, key, fold, cells, seed)
    fitted, scans = fit_together(rows, [cells.index((f, how)) for f, _, how in settings], [l2 for _, l2, _ in settings], max_iter)
    told = {settings[r["setting"]]: (r["loss"], r["accuracy"]) for r in held_out(dev, y, fold, [f for f, *_ in settings], fitted).collect()}
    found = [(int(t["number"]), f, *told[f, float(t.get("l2_penalty", 0.0)), t.get("class_handling", "none")]) for t in trials for f in folds]
    return found, scans + 1
