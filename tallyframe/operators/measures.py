"""Statistical measures of summaries.

A measure is built from a few mergeable aggregates (sums, minima, maxima, counts) shared by all
measures of a summary, and a closing expression over them. The aggregates are computed once at the finest
grouping, combined map-side, and rolled up to every marginal from there. Quantiles are exact and are
not sums: see the module quantiles.
"""

from __future__ import annotations

import copy
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, functions as F

from tallyframe.functions import intervals

if TYPE_CHECKING:
    from tallyframe.meta import Dataset


class Aggregates:
    """The mergeable aggregates that the measures of one summary need, each computed once."""

    MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, str, Column]] = {}

    def _add(self, how: str, key: str, expression: Column) -> Column:
        return F.col(self.known.setdefault(f"{how} {key}", (f"__a{len(self.known)}", how, expression))[0])

    def sum(self, key: str, expression: Column) -> Column:
        return self._add("sum", key, expression)

    def count(self, key: str, condition: Column) -> Column:
        return F.coalesce(self._add("sum", f"count {key}", F.when(condition, 1).otherwise(0).cast("bigint")), F.lit(0))

    def min(self, key: str, expression: Column) -> Column:
        return self._add("min", key, expression)

    def max(self, key: str, expression: Column) -> Column:
        return self._add("max", key, expression)

    def first(self) -> list[Column]:
        return [self.MERGE[how](e).alias(name) for name, how, e in self.known.values()]

    def again(self) -> list[Column]:
        return [self.MERGE[how](name).alias(name) for name, how, _ in self.known.values()]


REGISTRY: dict[str, type[Measure]] = {}


class Measure:
    """A statistic of a column, optionally weighted.

    weight: a column, None for that of the summary or dataset, False for none. Negative weights count
    as 0; with exclude_nonpositive_weights those of 0 and less are missing. A missing weight makes the
    value missing. A statistic of a cell without values is null. Own measures subclass this, set `stat`
    and give `parts`.
    """

    stat = ""
    weightable = True
    needs_column = True
    #: Whether squares are summed: then about a value of the column, so that a mean far from 0 costs no digits.
    centred = False
    centre = 0.0

    def __init__(self, column: str | None = None, weight: str | bool | None = None, exclude_nonpositive_weights: bool = False, conflev: float = 0.95, label: str = "", **options: Any) -> None:
        if self.needs_column and not column:
            raise ValueError(f"{self.stat} needs a column")
        self.column, self.weight, self.exclude, self.conflev, self.label, self.options = column, weight, exclude_nonpositive_weights, conflev, label, options
        intervals.alpha_of(conflev)

    def __init_subclass__(cls) -> None:
        if cls.stat:
            REGISTRY[cls.stat] = cls

    def name(self) -> str:
        return self.stat + (f"_of_{self.column}" if self.column else "") + (f"_wgtd_by_{self.weight}" if self.weight else "")

    def settled(self, ds: Dataset, default_weight: str | None) -> Measure:
        """A copy with its weight decided and the roles of its columns checked."""
        from tallyframe.meta import RoleError

        out = copy.copy(self)
        out.weight = (default_weight if self.weightable else None) if self.weight is None else self.weight or None
        if out.weight and not self.weightable:
            raise RoleError(f"{self.stat} has no weighted form")
        for c in (out.column, out.weight):
            if c and not ds.is_scalar(c):
                raise RoleError(f"{self.stat} needs a scalar column, but {c!r} is {ds.meta(c).role}")
        return out

    def values(self) -> tuple[Column, Column]:
        """The datum and its weight as doubles, null together where either is missing."""
        x = F.col(f"`{self.column}`").cast("double") if self.column else F.lit(1.0)
        x = F.when(~F.isnan(x), x)
        if not self.weight:
            return x, F.when(x.isNotNull(), F.lit(1.0))
        raw = F.col(f"`{self.weight}`").cast("double")
        w = F.when(raw > 0, raw) if self.exclude else F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))
        return F.when(w.isNotNull(), x), F.when(x.isNotNull(), w)

    def build(self, a: Aggregates) -> dict[str, Column]:
        out = self.parts(_Sums(self, a))
        return {self.name() + suffix: e for suffix, e in (out if isinstance(out, dict) else {"": out}).items()}

    def parts(self, s: _Sums) -> Column | dict[str, Column]:
        raise NotImplementedError


class _Sums:
    """The usual sums over a measure's values, by name."""

    def __init__(self, m: Measure, a: Aggregates) -> None:
        self.m, self.a, self.key = m, a, f"{m.column} {m.weight} {m.exclude}"
        self.x, self.w_ = m.values()

    @property
    def n(self) -> Column:  # pairs of value and weight
        return self.a.count(f"x {self.key}", self.x.isNotNull())

    @property
    def w(self) -> Column:  # sum of weights
        return self.a.sum(f"w {self.key}", self.w_) if self.m.weight else self.n.cast("double")

    @property
    def wx(self) -> Column:
        return self.a.sum(f"wx {self.key}", self.x * self.w_ if self.m.weight else self.x)

    @property
    def mean(self) -> Column:
        return F.try_divide(self.wx, self.w)

    @property
    def squares(self) -> Column:  # weighted squares about the weighted mean
        off, key = self.x - F.lit(self.m.centre), f"{self.key} {self.m.centre}"
        first, second = (off * self.w_, off * off * self.w_) if self.m.weight else (off, off * off)
        raw, shift = self.a.sum(f"wdd {key}", second), self.a.sum(f"wd {key}", first)
        return F.greatest(F.lit(0.0), raw - shift * F.try_divide(shift, self.w))

    @property
    def stderr(self) -> Column:
        return F.when((self.n > 1) & (self.w > 0), F.sqrt(self.squares / F.greatest(self.n - 1, F.lit(1)) / self.w))

    @property
    def sample_variance(self) -> Column:
        d = self.w - 1
        return F.when((self.n > 1) & (d > 0), self.squares / d) if not self.m.weight else F.when(d > 0, self.squares / d)

    @property
    def population_variance(self) -> Column:
        return F.when(self.w > 0, self.squares / self.w)


class freq(Measure):
    """Count of rows, or sum of weights; 0 for an empty cell."""

    stat, needs_column = "freq", False

    def parts(self, s):
        return F.coalesce(s.w, F.lit(0.0)) if self.weight else F.coalesce(s.a.count("rows", F.lit(True)), F.lit(0))


class freqcl(Measure):
    """Count with Poisson confidence limits (method daly or byar); weighted: limits scaled by the weights, a rough approximation."""

    stat, needs_column = "freqcl", False

    def parts(self, s):
        n = F.coalesce(s.n, F.lit(0))
        limits = intervals.count_limits(n, self.conflev, self.options.get("method", "daly"))
        total = F.coalesce(s.w, F.lit(0.0)) if self.weight else n.cast("double")
        scale = F.coalesce(F.try_divide(total, n), F.lit(0.0)) if self.weight else F.lit(1.0)
        return {"": total, "_ll": limits["lower"] * scale, "_ul": limits["upper"] * scale}


class asum(Measure):
    """Sum, or weighted sum."""

    stat = "sum"

    def parts(self, s):
        return F.when(s.n > 0, s.wx)


class mean(Measure):
    """Arithmetic mean."""

    stat = "mean"

    def parts(self, s):
        return s.mean


class meancl(Measure):
    """Arithmetic mean with confidence limits by Student's t."""

    stat = "meancl"
    centred = True

    def parts(self, s):
        half = intervals.t_quantile(s.n - 1, self.conflev) * s.stderr
        return {"": s.mean, "_ll": s.mean - half, "_ul": s.mean + half}


class geomean(Measure):
    """Geometric mean; values of 0 and less are left out. compat=True ignores weights."""

    stat = "geomean"

    def parts(self, s):
        positive = s.x > 0
        ln = F.when(positive, F.ln(F.when(positive, s.x)))
        if self.weight and not self.options.get("compat"):
            return F.exp(F.try_divide(s.a.sum(f"wln {s.key}", ln * s.w_), s.a.sum(f"wpos {s.key}", F.when(positive, s.w_))))
        return F.exp(F.try_divide(s.a.sum(f"ln {s.key}", ln), s.a.count(f"pos {s.key}", positive)))


class minimum(Measure):
    """Least value."""

    stat = "minimum"

    def parts(self, s):
        return s.a.min(s.key, s.x)


class maximum(Measure):
    """Greatest value."""

    stat = "maximum"

    def parts(self, s):
        return s.a.max(s.key, s.x)


class arange(Measure):
    """Greatest less least value."""

    stat = "range"

    def parts(self, s):
        return s.a.max(s.key, s.x) - s.a.min(s.key, s.x)


class samplevar(Measure):
    """Sample variance: divided by n - 1, or by the sum of weights less 1."""

    stat = "samplevar"
    centred = True

    def parts(self, s):
        return s.sample_variance


class popvar(Measure):
    """Population variance."""

    stat = "popvar"
    centred = True

    def parts(self, s):
        return s.population_variance


class stddev(Measure):
    """Sample standard deviation."""

    stat = "stddev"
    centred = True

    def parts(self, s):
        return F.sqrt(s.sample_variance)


class popstddev(Measure):
    """Population standard deviation."""

    stat = "popstddev"
    centred = True

    def parts(self, s):
        return F.sqrt(s.population_variance)


class samplecv(Measure):
    """Sample coefficient of variation, in percent."""

    stat = "samplecv"
    centred = True

    def parts(self, s):
        return F.try_divide(F.sqrt(s.sample_variance), s.mean) * 100


class popcv(Measure):
    """Population coefficient of variation, in percent."""

    stat = "popcv"
    centred = True

    def parts(self, s):
        return F.try_divide(F.sqrt(s.population_variance), s.mean) * 100


class stderr(Measure):
    """Standard error of the mean."""

    stat = "stderr"
    centred = True

    def parts(self, s):
        return s.stderr


class nonmissing(Measure):
    """Count of values; with a weight, of values whose weight is not missing."""

    stat = "nonmissing"

    def parts(self, s):
        return s.n


class missing(Measure):
    """Count of rows without a value."""

    stat = "missing"

    def parts(self, s):
        return s.a.count("rows", F.lit(True)) - s.n


class studentt(Measure):
    """Student's t statistic against muzero (0)."""

    stat, weightable = "t", False
    centred = True

    def parts(self, s):
        return F.try_divide(s.mean - F.lit(float(self.options.get("muzero", 0.0))), s.stderr)


class quantile(Measure):
    """Exact quantile p; defn: SAS definition 1 to 5 (default 5). Weighted: by cumulative weight."""

    stat = "quantile"

    def __init__(self, column: str, p: float = 0.5, weight: str | bool | None = None, defn: int = 5, **options: Any) -> None:
        super().__init__(column, weight, **options)
        if not 0 <= p <= 1 or defn not in (1, 2, 3, 4, 5):
            raise ValueError("p must be from 0 to 1 and defn from 1 to 5")
        self.p, self.defn = p, defn

    def name(self) -> str:
        tail = f"_of_{self.column}" + (f"_wgtd_by_{self.weight}" if self.weight else "")
        return (self.stat if type(self) is not quantile else f"quantile_{self.p:g}".replace(".", "_") + (f"_def{self.defn}" if self.defn != 5 else "")) + tail

    def targets(self, total: Column) -> list[tuple[Column, bool]]:
        """(threshold, strict): the least value whose cumulative weight reaches, or if strict exceeds, it."""
        at = total * F.lit(self.p)
        if self.weight or self.defn == 5:
            return [(at, False), (at, True)]
        if self.defn == 4:
            at = (total + 1) * F.lit(self.p)
        j = F.floor(at)
        if self.defn == 3:
            return [(at, False)]
        if self.defn == 2:
            half, even = at - j == 0.5, j % 2 == 0
            return [(F.when(half, F.when(even, j).otherwise(j + 1)).otherwise(F.floor(at + 0.5)).cast("double"), False)]
        return [(j.cast("double"), False), ((j + 1).cast("double"), False)]

    def close(self, found: list[Column], total: Column) -> Column:
        if len(found) == 1:
            return found[0]
        if self.weight or self.defn == 5:
            return (found[0] + found[1]) / 2
        at = (total + 1 if self.defn == 4 else total) * F.lit(self.p)
        j = F.floor(at)
        # x_0 is x_1 and x_(n+1) is x_n.
        return F.when(j < 1, found[1]).otherwise((1 - (at - j)) * found[0] + (at - j) * found[1])


    def closed(self, found: list[Column], total: Column) -> dict[str, Column]:
        """The columns of the measure, by name."""
        return {self.name(): self.close(found, total)}


class quantiles(quantile):
    """Several exact quantiles p of a column by one definition, each a column named as quantile would name it."""

    stat = "quantiles"

    def __init__(self, column: str, p: tuple[float, ...] = (0.25, 0.5, 0.75), weight: str | bool | None = None, defn: int = 5, **options: Any) -> None:
        self.each = [quantile(column, q, weight, defn, **options) for q in p]
        if not self.each:
            raise ValueError("give at least one p")
        super().__init__(column, p[0], weight, defn, **options)

    def settled(self, ds: Dataset, default_weight: str | None) -> Measure:
        out = super().settled(ds, default_weight)
        out.each = [q.settled(ds, default_weight) for q in self.each]
        return out

    def name(self) -> str:
        return "quantiles_" + "_".join(q.name() for q in self.each)

    def targets(self, total: Column) -> list[tuple[Column, bool]]:
        return [t for q in self.each for t in q.targets(total)]

    def closed(self, found: list[Column], total: Column) -> dict[str, Column]:
        out, i = {}, 0
        for q in self.each:
            n = len(q.targets(total))
            out |= q.closed(found[i : i + n], total)
            i += n
        return out


class _FixedQuantile(quantile):
    fixed = 0.5

    def __init__(self, column: str, weight: str | bool | None = None, **options: Any) -> None:
        super().__init__(column, self.fixed, weight, **options)


class median(_FixedQuantile):
    """Median."""

    stat = "median"


class p10(_FixedQuantile):
    """Tenth percentile."""

    stat, fixed = "p10", 0.1


class p25(_FixedQuantile):
    """First quartile."""

    stat, fixed = "p25", 0.25


class p75(_FixedQuantile):
    """Third quartile."""

    stat, fixed = "p75", 0.75


class p90(_FixedQuantile):
    """Ninetieth percentile."""

    stat, fixed = "p90", 0.9


def applyto(*arguments: Any, **options: Any) -> list[Measure]:
    """Every given measure of every given column."""
    columns = [a for a in arguments if isinstance(a, str)]
    return [m(c, **options) for c in columns for m in arguments if not isinstance(m, str)]


def stat_methods() -> list[str]:
    return sorted(REGISTRY)


def stat_method_help() -> dict[str, str]:
    return {n: (REGISTRY[n].__doc__ or "").strip() for n in stat_methods()}
