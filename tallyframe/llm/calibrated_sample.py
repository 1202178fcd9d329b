"""A sample whose category shares follow given targets, with floors per category and a report of gaps.

Goals come from calibration. A cell (a combination of categories) starts from its share of the sample and is
tilted by exp(sum of the multipliers of the margins it belongs to: each sex, each region, each age group, and
the whole), but never below its floor nor above what it has. So what an exhausted cell cannot give is given by
cells of the same sex, region and age group as far as they can. The multipliers are found by Newton steps on
the convex dual of the exponential-tilting distance, which needs only the counts of units by cell, aggregated
distributedly once; a unit itself never leaves its task.

The sample is drawn by the pivotal method: two undecided units of a category play off their probabilities
until one is decided. All neighbouring pairs of a batch duel at once, round after round. Each partition does
this for its own units, which leaves at most one undecided unit per category and partition; those few then
play on per category. All random numbers are hashes of seed and unit, so a task that is run again decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyframe.plans.scale import cut


def required_rows(target_ppm: int, min_rows: int, size: int) -> int:
    """The greater of the floor and the share of the size, rounded up."""
    return max(min_rows or 0, -((-(target_ppm or 0) * size) // 1_000_000))


def calibrate(start: np.ndarray, low: np.ndarray, high: np.ndarray, design: np.ndarray, totals: np.ndarray, ridge: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """x[c] = start[c] exp(design[c] m), kept within [low[c], high[c]], with design' x as near to totals as that allows.

    design[c, k]: 1 if cell c belongs to margin k. m minimises the convex dual
    D(m) = sum_c P_c(design[c] m) - totals m + ridge m^2 / 2, where P_c grows at the rate x[c]. Newton steps, in which the
    cells that are at a limit have no curvature; a step is halved while D does not fall. ridge, per margin, decides which
    margins give way where they cannot all be met, and keeps m finite. Cells with start 0 stay at their floor.
    """
    x0, z, t = start.astype(float), design.astype(float), totals.astype(float)
    eps = np.full(z.shape[1], 1e-6) if ridge is None else ridge.astype(float)
    low, high = low.astype(float), np.maximum(high, low).astype(float)
    live = x0 > 0
    with np.errstate(divide="ignore"):
        a = np.where(live & (low > 0), np.log(np.where(low > 0, low, 1) / np.where(live, x0, 1)), -np.inf)
        b = np.where(live & (high > 0), np.log(np.where(high > 0, high, 1) / np.where(live, x0, 1)), -np.inf)

    def rate(s: np.ndarray) -> np.ndarray:
        return np.where(live, np.clip(x0 * np.exp(np.clip(s, -700, 700)), low, high), low)

    def dual(m: np.ndarray) -> float:
        s = z @ m
        mid = np.clip(s, a, b)
        # The integral of the rate: low up to a, exponential between, high beyond b.
        inner = np.where(np.isfinite(mid), x0 * np.exp(np.where(np.isfinite(mid), mid, 0)), 0.0)
        p = inner + np.where(s < a, low * (s - np.where(np.isfinite(a), a, 0)), 0) + np.where(s > b, high * (s - np.where(np.isfinite(b), b, 0)), 0)
        return float(np.where(live, p, low * s).sum() - t @ m + (eps * m * m).sum() / 2)

    m = np.zeros(z.shape[1])
    for _ in range(steps):
        s = z @ m
        x = rate(s)
        gradient = z.T @ x - t + eps * m
        if np.abs(gradient).max(initial=0.0) < 1e-9 * max(1.0, np.abs(t).max(initial=0.0)):
            break
        curved = live & (s > a) & (s < b)
        hessian = (z[curved].T * x[curved]) @ z[curved] + np.diag(eps)
        step = np.linalg.solve(hessian, gradient)
        scale, now, fall = 1.0, dual(m), float(gradient @ step)
        while scale > 1e-12 and dual(m - scale * step) > now - 1e-4 * scale * fall:
            scale /= 2
        if scale <= 1e-12:
            break
        m = m - scale * step
    return rate(z @ m)


def margins(cells: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, list[tuple[str, object]]]:
    """The design of the cells: a column for every value of each category (null being one), then one for all."""
    columns, names = [], []
    for c in by:
        values = cells[c].astype(object).where(cells[c].notna(), None)
        for v in sorted(set(values), key=lambda v: (v is not None, v)):
            columns.append(np.array([x == v if v is not None else x is None for x in values], float))
            names.append((c, v))
    columns.append(np.ones(len(cells)))
    return np.stack(columns, axis=1), [*names, ("all", None)]


def whole_rows(x: np.ndarray, low: np.ndarray, high: np.ndarray, total: int) -> np.ndarray:
    """x in whole rows within [low, high] that add up to total, or as near to it as the limits allow.

    Rounded down, then the largest remainders get a row more; where that is not enough, all cells that can still
    move share what is left in proportion to their size until none can.
    """
    out = np.clip(np.floor(x + 1e-9), low, high).astype(np.int64)
    rest = np.argsort(-(x - np.floor(x + 1e-9)), kind="stable")
    while (left := total - int(out.sum())) != 0:
        room = high - out if left > 0 else out - low
        movable = rest[room[rest] > 0]
        if not len(movable):
            break
        sign = 1 if left > 0 else -1
        if abs(left) <= len(movable):
            out[movable[: abs(left)] if left > 0 else movable[::-1][: abs(left)]] += sign
            continue
        weight = np.maximum(out[movable], 1).astype(float)
        give = np.minimum(room[movable], np.maximum(1, np.floor(abs(left) * weight / weight.sum()))).astype(np.int64)
        out[movable] += sign * np.where(np.cumsum(give) <= abs(left), give, 0)
    return out


def cell_counts(units: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """targets with available: the units whose category columns are equal, null matching null; 0 if none."""
    have = units.groupBy(*by).agg(F.count(F.lit(1)).alias("available"))
    h = have.select(*[F.col(c).alias(f"h_{c}") for c in by], "available")
    return targets.join(h, [targets[c].eqNullSafe(F.col(f"h_{c}")) for c in by], "left").drop(*[f"h_{c}" for c in by]).withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))


#: Weight of a gap of a margin, and of the whole sample, against the distance of the cells from their targets: smaller is stricter.
MARGIN_RIDGE, TOTAL_RIDGE = 1e-2, 1e-6


def plan_sample(cells: pd.DataFrame, size: int, by: list[str]) -> pd.DataFrame:
    """required, goal, probability and gap of each target cell (columns by, available, target_ppm, min_rows).

    goal: at least the required rows as far as there are any, and never more than there are. What exhausted cells leave
    of the size goes to the others by calibration to the targets of the margins. The goals add up to the size, or to
    the required rows if these are more, or to all there is if that is less. gap: required less available, 0 at least.
    """
    out = cells.copy()
    ppm, floor = out["target_ppm"].fillna(0).astype("int64"), out["min_rows"].fillna(0).astype("int64")
    out["required"] = np.array([required_rows(int(a), int(b), size) for a, b in zip(ppm, floor)], dtype="int64")
    have = out["available"].to_numpy(dtype="int64")
    low = np.minimum(out["required"].to_numpy(), have)
    design, _ = margins(out, by)
    share = ppm.to_numpy() * (size / 1_000_000)
    ridge = np.full(design.shape[1], MARGIN_RIDGE)
    ridge[-1] = TOTAL_RIDGE
    # A cell without a target gives its floor only.
    high = np.where(share > 0, have, low)
    goal = calibrate(share, low, high, design, np.append((design.T @ share)[:-1], float(size)), ridge)
    out["goal"] = whole_rows(goal, low, high, max(size, int(low.sum())))
    out["probability"] = np.divide(out["goal"].to_numpy(float), have, out=np.zeros(len(out)), where=have > 0)
    out["gap"] = np.maximum(out["required"].to_numpy() - have, 0)
    out.attrs["size"] = size
    return out


def margin_report(plan: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """category, value, target (rows of a sample of the wanted size), goal (rows) and available of every margin of a plan; the last row is the whole."""
    design, names = margins(plan, by)
    size = plan.attrs["size"]
    target = design.T @ (plan["target_ppm"].fillna(0).to_numpy(float) * size / 1_000_000)
    return pd.DataFrame(
        {
            "category": [c for c, _ in names], "value": [None if v is None else str(int(v)) if isinstance(v, (int, float, np.integer)) else str(v) for _, v in names],
            "target": target, "goal": (design.T @ plan["goal"].to_numpy(float)).astype("int64"), "available": (design.T @ plan["available"].to_numpy(float)).astype("int64"),
        }
    )


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes."""
    with np.errstate(over="ignore"):
        z = h + _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def duels(cell: np.ndarray, p: np.ndarray, h: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pivotal method within each cell: decisions (1 taken, 0 not, -1 undecided) and the probabilities left.

    cell: whole numbers; h: a hash of each unit. In a round every undecided unit meets its neighbour in its cell; one
    of the two, at least, is decided. At most one unit of a cell stays undecided: one whose probability is neither 0 nor 1.
    """
    p = p.astype(float).copy()
    took = np.where(p >= 1 - 1e-12, 1, np.where(p <= 1e-12, 0, -1)).astype(np.int8)
    open_ = np.flatnonzero(took == -1)
    open_ = open_[np.argsort(cell[open_], kind="stable")]
    round_ = 0
    while len(open_):
        c = cell[open_]
        start = np.ones(len(c), bool)
        start[1:] = c[1:] != c[:-1]
        at = np.arange(len(c)) - np.flatnonzero(start)[np.cumsum(start) - 1]  # place in its cell
        left = np.flatnonzero((at[:-1] % 2 == 0) & ~start[1:])
        if not len(left):
            break
        i, j = open_[left], open_[left + 1]
        a, b = p[i], p[j]
        s = a + b
        with np.errstate(over="ignore"):
            u = _uniform(h[i] * np.uint64(3) ^ h[j] ^ np.uint64((seed * 64 + round_) % (1 << 62)))
        low = s < 1
        # Below 1 one of the two is out and the other has the sum; from 1 on one is in and the other has the rest.
        first = np.where(low, u * s < a, u * (2 - s) < 1 - b)
        keep, done = np.where(first, i, j), np.where(first, j, i)
        keep, done = np.where(low, keep, done), np.where(low, done, keep)
        took[done] = np.where(low, 0, 1)
        left_p = np.where(low, s, s - 1)
        p[keep] = left_p
        took[keep] = np.where(left_p >= 1 - 1e-9, 1, np.where(left_p <= 1e-9, 0, -1))
        open_ = open_[took[open_] == -1]
        round_ += 1
    return took, p


def pivotal(units: DataFrame, unit: str, cell: str, probability: str, seed: int = 1) -> DataFrame:
    """The chosen rows of units (columns unit, cell) under the given inclusion probabilities.

    Every cell gets the sum of its probabilities, within rounding of doubles: exact where it is whole.
    unit should be unique. Null or zero probabilities are never chosen, those of 1 always. Nothing is shuffled but the
    undecided unit of each cell and partition; the partitions of units should be the same whenever they are computed.
    """
    schema = f"unit {dict(units.dtypes)[unit]}, cell {dict(units.dtypes)[cell]}, p double, took tinyint"
    rows = units.where(F.col(probability) > 0).select(F.col(unit).alias("unit"), F.col(cell).alias("cell"), F.col(probability).cast("double").alias("p"), F.xxhash64(F.lit(seed), F.col(unit)).alias("h"))

    def play(frame: pd.DataFrame, salt: int) -> pd.DataFrame:
        code = pd.factorize(frame["cell"], use_na_sentinel=False)[0]
        took, p = duels(code, frame["p"].to_numpy(), frame["h"].to_numpy(np.int64).view(np.uint64), salt)
        return frame.assign(took=took, p=p)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # one undecided unit per cell
        for k, frame in enumerate(frames):
            done = play(frame if held is None else pd.concat([held, frame], ignore_index=True), k)
            held = done.loc[done["took"] == -1, ["unit", "cell", "p", "h"]]
            yield done.loc[done["took"] == 1, ["unit", "cell", "p", "took"]]
        if held is not None and len(held):
            yield held.assign(took=np.int8(-1))[["unit", "cell", "p", "took"]]

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        done = play(frame.sort_values("unit").reset_index(drop=True), 1 << 20)
        # What is left of a cell whose probabilities do not add up to a whole number is drawn by itself.
        drawn = _uniform(done["h"].to_numpy(np.int64).view(np.uint64) ^ _MIX[1]) < done["p"]
        return done.assign(took=np.where(done["took"] == -1, drawn, done["took"]).astype(np.int8))[["unit", "cell", "p", "took"]]

    first = cut(rows.mapInPandas(local, schema))
    rest = first.where("took = -1").select("unit", "cell", "p", F.xxhash64(F.lit(seed + 1), "unit").alias("h"))
    # At most one unit per cell and partition is left here, so a cell's group is small.
    decided = rest.groupBy("cell").applyInPandas(last, schema)
    return first.where("took = 1").select("unit", "cell").unionByName(decided.where("took = 1").select("unit", "cell"))


def discharges(df: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """One row per unit and category; repeated deliveries of a unit collapse. Units that are null are none."""
    return df.where(F.col(unit).isNotNull()).groupBy(unit, *by).agg(F.count(F.lit(1)).alias("n_rows"))


def sample_report(df: DataFrame, targets: DataFrame, unit: str, by: list[str], share: int = 10) -> tuple[pd.DataFrame, DataFrame]:
    """The plan (one row per target cell, so of fixed size) and the units it was made from."""
    units = cut(discharges(df, unit, by))
    size = units.agg(F.count_distinct(F.col(unit))).first()[0] // share
    cells = cell_counts(units, targets, by).toPandas()
    return plan_sample(cells, size, by), units
