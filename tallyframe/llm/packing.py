"""Fill containers of fixed capacity with items of varying size, leaving little room unused.

Sizes are whole numbers, so all items of one size are alike and a histogram of sizes (at most
`capacity` entries, whatever the number of items) is the whole problem:

1. The configuration linear program (patterns of sizes that fit a container, each size covered) is
   solved approximately by multiplicative weights: every size has a weight; the knapsack dynamic
   program over the capacity prices the patterns; a pattern is used a bounded amount; and the weights
   of the sizes it serves fall with the share of their demand served, until every demand is covered.
2. The fractional solution is rounded to whole containers, never using more items than there are, and
   the program solved again for what is left, until that is 1 % of the load. That rest is placed by best
   fit, the largest size first, in bulk: all containers with the same contents are handled at once.
   All steps cost what the histogram costs.
3. The plan says which ranks of each size go to which containers. Items get their rank within their
   size from a window over (size, salt) plus the counts of the salts before, so an item finds
   its container by itself and a size that a third of all items have is spread over many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.plans.scale import cut

#: Items of one salt: the rows a task ranks at once.
SALT_ROWS = 200_000
#: Share of a demand that one use of a pattern serves, and how fast a weight falls with the share served.
STEP, SHARPNESS = 0.05, 8.0
#: A container is taken from the solution if at most 1 / FULL of it is empty; best fit gets the rest once it is 1 / REST of the load.
FULL, REST = 1000, 100


def room_values(price: np.ndarray) -> np.ndarray:
    """The greatest value that fits every room from 0 up; price[s] is the value of size s, -inf where there is none."""
    worth = np.zeros(len(price))
    for c in range(1, len(price)):
        worth[c] = max(worth[c - 1], (worth[c - 1 :: -1] + price[1 : c + 1]).max())
    return worth


def fill_container(price: np.ndarray, worth: np.ndarray, limits: np.ndarray, first: int = 0) -> dict[int, int]:
    """Size -> number of a container filled by the values of its rooms, never above the limits; first goes in first."""
    count: dict[int, int] = {}
    room, s = len(price) - 1, first
    while True:
        if s:
            count[s] = count.get(s, 0) + 1
            room -= s
        if not room:
            return count
        gain = worth[room - 1 :: -1] + price[1 : room + 1]
        for k, n in count.items():
            if k <= room and n >= limits[k]:
                gain[k - 1] = -np.inf
        s = int(gain.argmax()) + 1
        if gain[s - 1] == -np.inf:
            return count


def knapsack_pattern(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes of greatest value within capacity, by dynamic programming.

    Returns (count per size, value). The value is that of any number of a size, an upper bound; the limits
    are kept while the container is filled, so a size that is used up gives its room to the next best.
    """
    price, most = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1)
    price[sizes], most[sizes] = values, limits
    price[most < 1] = -np.inf
    worth = room_values(price)
    count = fill_container(price, worth, most)
    return np.array([count.get(int(s), 0) for s in sizes], np.int64), float(worth[capacity])


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float = STEP, sharpness: float = SHARPNESS) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Patterns, their fractional use, and a lower bound of the containers needed.

    There are 1 / step rounds, however many sizes there are. A round prices all rooms once and ends when
    every size has its share of the demand, round * step: a size behind it goes first into a pattern, which
    is used for `step` of the demand of its scarcest size at most and never beyond the demand. So the
    use covers every demand exactly, with nothing to scale.
    The weights are dual prices: divided by what the best pattern is worth, they bound the optimum from
    below (weak duality), as does the total size.
    """
    wanted = np.zeros(capacity + 1)
    wanted[sizes] = demand
    base = np.full(capacity + 1, -np.inf)
    base[sizes] = sizes / capacity
    served = np.zeros(capacity + 1)  # share of the demand
    price = base.copy()
    use: dict[tuple[tuple[int, int], ...], float] = {}
    bound = float((sizes * demand).sum()) / capacity
    rounds = round(1 / step)
    for r in range(1, rounds + 1):
        worth = room_values(price)
        if worth[capacity] > 0:
            open_ = price > 0
            bound = max(bound, float((price[open_] * wanted[open_]).sum()) / worth[capacity])
        share = r / rounds
        for s in sizes[::-1].tolist():
            while served[s] < share - 1e-9:
                count = fill_container(price, worth, wanted, s)
                k, n = np.fromiter(count, np.int64), np.fromiter(count.values(), np.float64)
                most = wanted[k] / n
                amount = float(min(step * most.min(), ((1 - served[k]) * most).min()))
                served[k] += amount / most
                price[k] = np.where(served[k] < 1 - 1e-9, base[k] * np.exp(-sharpness * (served[k] - share)), -np.inf)
                pattern = tuple(sorted(count.items()))
                use[pattern] = use.get(pattern, 0.0) + amount
    return [dict(p) for p in use], np.array(list(use.values())), bound


def best_fit(left: dict[int, int], capacity: int, room: dict[int, list[list]] | None = None) -> list[tuple[Counter, int]]:
    """Place counted sizes by best fit, largest first; equal containers are moved together.

    Returns (contents, number of containers).
    """
    open_: dict[int, list[list]] = room or {}  # free room -> [contents, number]
    for s in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[s]
        while n:
            at = min((f for f in open_ if f >= s and open_[f]), default=None)
            if at is None:
                fit = capacity // s
                full, rest = divmod(n, fit)
                for times, number in ((fit, full), (rest, 1)):
                    if times and number:
                        open_.setdefault(capacity - times * s, []).append([Counter({s: times}), number])
                break
            contents, number = open_[at].pop()
            fit = min(at // s, n)
            moved = min(number, n // fit)
            if number > moved:
                open_[at].append([contents, number - moved])
            open_.setdefault(at - fit * s, []).append([contents + Counter({s: fit}), moved])
            n -= fit * moved
    return [(c, n) for groups in open_.values() for c, n in groups if n]


def take_whole(left: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], float]:
    """Whole containers of the solved program for what is left, which is lowered; and the lower bound."""
    sizes = np.array(sorted(s for s, n in left.items() if n > 0), np.int64)
    rows, use, bound = solve_configurations(sizes, np.array([left[s] for s in sizes.tolist()], np.float64), capacity)
    plan: list[tuple[Counter, int]] = []
    room = [capacity - sum(s * k for s, k in p.items()) for p in rows]
    full = sorted((i for i in range(len(rows)) if room[i] * FULL <= capacity), key=lambda i: (room[i], -use[i]))
    # Rounded down first, then up where the items are still there.
    for up in (0, 1):
        for i in full:
            number = min(int(use[i] + 1e-9) if not up else 1, min(left[s] // k for s, k in rows[i].items()))
            if number > 0:
                plan.append((Counter(rows[i]), number))
                for s, k in rows[i].items():
                    left[s] -= number * k
    return plan, bound


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], float]:
    """(contents, number of containers) that hold exactly the counted sizes, and the lower bound."""
    by_program, by_best_fit, bound = plan_parts(histogram, capacity)
    return by_program + by_best_fit, bound


def plan_parts(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], list[tuple[Counter, int]], float]:
    """What the rounded program and the best fit place, and the lower bound."""
    left = {int(s): int(n) for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    if not left:
        return [], [], 0.0
    load = sum(s * n for s, n in left.items())
    plan, bound = take_whole(left, capacity)
    rest = sum(s * n for s, n in left.items())
    while rest * REST > load:
        more, _ = take_whole(left, capacity)
        if not more:
            break
        plan += more
        rest = sum(s * n for s, n in left.items())
    return plan, best_fit(left, capacity), bound


def plan_table(plan: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first container and items per container of each run of containers."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: Counter = Counter()
    container = 0
    for contents, number in plan:
        for s, k in contents.items():
            runs.setdefault(s, []).append((next_rank[s], container, k))
            next_rank[s] += k * number
        container += number
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece_no, first_unit, size: whole items, or for those above capacity pieces of it and a rest."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    number = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1))
    cut_up = items.select(F.col(key), n.alias("__n"), F.posexplode(F.sequence(F.lit(1), number.cast("bigint"))).alias("piece_no", "__p"))
    first = F.col("piece_no").cast("bigint") * capacity
    return cut_up.select(key, "piece_no", first.alias("first_unit"), F.least(F.lit(capacity), F.col("__n") - first).cast("int").alias("size"))


def size_histogram(table: DataFrame) -> dict[int, int]:
    """size -> number of pieces: at most capacity + 1 rows, whatever the number of items."""
    return {r["size"]: r["n"] for r in table.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack_report(items: DataFrame, size: str, capacity: int) -> dict[str, int | float]:
    """How the items would be placed: counts, the lower bound of containers, and the parts of the program and of best fit.

    n_full_pieces: pieces that fill a container alone; the program places them too.
    """
    n = F.count(F.lit(1))
    counted = pieces(items, size, size, capacity).groupBy("size").agg(n.alias("n"), F.count_if(F.col("piece_no") == 0).alias("first")).collect()  # at most capacity + 1 rows
    held = {r["size"]: r["n"] for r in counted}
    program, rest, bound = plan_parts(held, capacity)
    return {
        "n_items": sum(r["first"] for r in counted), "n_ids": sum(s * n for s, n in held.items()), "n_containers": sum(n for _, n in program + rest), "lower_bound": bound, "n_by_program": sum(n for _, n in program),
        "n_by_best_fit": sum(n for _, n in rest), "ids_by_best_fit": sum(n * sum(s * k for s, k in c.items()) for c, n in rest), "n_full_pieces": held.get(capacity, 0),
    }


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece_no, first_unit, size, container_id of every piece of every item.

    An item is one piece unless larger than capacity: then all its pieces but the last fill a container.
    Null and negative sizes count as 0; items of size 0 take no room and are spread over the containers.
    An empty table gives no rows. Keys may repeat or be null; each row is an item.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    table = cut(pieces(items, key, size, capacity))
    histogram = size_histogram(table)
    plan, _ = plan_containers(histogram, capacity)
    containers = max(1, sum(n for _, n in plan))
    runs = table.sparkSession.sparkContext.broadcast((plan_table(plan), containers))

    salts = max(1, -(-sum(histogram.values()) // SALT_ROWS))
    salt = F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int")
    salted = table.withColumn("salt", salt)
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("size").alias("b_size"), F.col("salt").alias("b_salt"), (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "piece_no")) - 1)
    ranked = ranked.join(before, (F.col("size") == F.col("b_size")) & (F.col("salt") == F.col("b_salt"))).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        by_size, number = runs.value
        for sizes, ranks in batches:
            s, r = sizes.to_numpy(), ranks.to_numpy()
            out = r % number
            for one in np.unique(s).tolist():
                if one:
                    first, base, per = by_size[one]
                    at = s == one
                    i = np.searchsorted(first, r[at], "right") - 1
                    out[at] = base[i] + (r[at] - first[i]) // per[i]
            yield pd.Series(out)

    container = F.pandas_udf(place, "bigint")
    return ranked.select(key, "piece_no", "first_unit", "size", container("size", "rank").alias("container_id"))
