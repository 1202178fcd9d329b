"""`summ`: dense contingency tables with marginals, measures and proportions.

Rows are aggregated once per set of multi-valued columns, at the finest grouping and combined map-side;
every marginal is rolled up from that small table, so a cube costs one scan. The table is dense: every
combination of the values present is a row, with count 0 if need be. Its domain is built by
exploding the arrays of values of each column, without a join of tables.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.meta import ColumnMeta, Dataset, RoleError
from tallyframe.operators.measures import Aggregates, Measure, quantile
from tallyframe.operators.quantiles import rank_values

#: Distinct values up to which a Python callable on values may be evaluated on the driver.
CALLABLE_VALUES = 10_000


class _Op:
    def __init__(self, *values: Any, **options: Any) -> None:
        self.values, self.options = values, options

    @property
    def function(self) -> Callable | None:
        return self.values[0] if len(self.values) == 1 and callable(self.values[0]) else None


class suppress(_Op):
    """Hide rows with these values; totals and proportions still include them."""


class retain(_Op):
    """Hide rows with other values."""


class coalesce(_Op):
    """Merge values into `value`, or the first listed; or map values by a callable. label: of the merged value."""


class order(_Op):
    """Listed values first, in this order, or by a comparison function; reverse=True turns the order."""


class reversed_order(order):
    """Turn the order of a condition column."""

    def __init__(self, *values: Any) -> None:
        super().__init__(*values, reverse=True)


class condcol:
    """A condition column with operations on its values, applied in the order given."""

    def __init__(self, name: str, *ops: _Op) -> None:
        self.name, self.ops = name, ops


def _distinct_values(df: DataFrame, column: str) -> list[Any]:
    kind = df.schema[column].dataType
    c = F.explode(f"`{column}`") if isinstance(kind, T.ArrayType) else F.col(f"`{column}`")
    rows = df.select(c.alias("v")).distinct().limit(CALLABLE_VALUES + 1).collect()
    if len(rows) > CALLABLE_VALUES:
        raise ValueError(f"{column!r} has more than {CALLABLE_VALUES} values: give an expression instead of a callable")
    return [r["v"] for r in rows]


class _Condition:
    """A condition column ready to use: its expression over rows, what is hidden, and its order."""

    def __init__(self, ds: Dataset, spec: str | condcol) -> None:
        spec = spec if isinstance(spec, condcol) else condcol(spec)
        self.name = spec.name
        kind = ds.kind(self.name)
        if not ds.is_discrete(self.name):
            raise RoleError(f"{self.name!r} is {ds.meta(self.name).role}; only discrete columns can be condition columns")
        self.multi = isinstance(kind, T.ArrayType)
        self.kind = kind.elementType if self.multi else kind
        self.all_value = ds.all_value(self.name)
        self.meta = ds.meta(self.name)
        c = F.col(f"`{self.name}`")
        self.hidden: Column = F.lit(False)
        self.sort: list[Column] = [c.asc_nulls_first()]
        merged: set[Any] = set()
        into: dict[Any, Any] = {}
        labels = dict(self.meta.labels) if isinstance(self.meta.labels, dict) else None
        for op in spec.ops:
            if isinstance(op, coalesce):
                if op.function:
                    into.update({v: op.function(v) for v in _distinct_values(ds.df, self.name)})
                    continue
                if again := merged & set(op.values):
                    raise ValueError(f"{self.name!r}: {sorted(map(str, again))} coalesced twice")
                merged |= set(op.values)
                target = op.options.get("value", op.values[0])
                into.update({v: target for v in op.values})
                if labels is not None:
                    labels[target] = op.options.get("label") or "/".join(str(labels.get(v, v)) for v in op.values)
            elif isinstance(op, (suppress, retain)):
                test = self._among(c, op, ds)
                self.hidden = self.hidden | (test if isinstance(op, suppress) else ~test)
            elif isinstance(op, order):
                self.sort = self._order(c, op, ds)
        if labels is not None:
            self.meta = replace(self.meta, labels=labels)
        self.row = self._mapped(c, into)
        self.meta = replace(self.meta, all_value=self.all_value)

    def _mapped(self, c: Column, into: dict[Any, Any]) -> Column:
        changed = {k: v for k, v in into.items() if k != v or (k is None) != (v is None)}

        def one(x: Column) -> Column:
            out = x
            for k, v in changed.items():
                out = F.when(x.eqNullSafe(F.lit(k)), F.lit(v).cast(self.kind)).otherwise(out)
            return out

        if self.multi:
            return F.array_distinct(F.coalesce(F.transform(c, one) if changed else c, F.array().cast(T.ArrayType(self.kind))))
        return one(c) if changed else c

    def _among(self, c: Column, op: _Op, ds: Dataset) -> Column:
        values = [v for v in _distinct_values(ds.df, self.name) if op.function(v)] if op.function else op.values
        some = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
        return F.coalesce(some, F.lit(False)) | (c.isNull() if None in values else F.lit(False))

    def _order(self, c: Column, op: _Op, ds: Dataset) -> list[Column]:
        listed = list(op.values)
        if op.function:
            listed = sorted(_distinct_values(ds.df, self.name), key=functools.cmp_to_key(op.function))
        rank = F.lit(len(listed))
        for i, v in reversed(list(enumerate(listed))):
            rank = F.when(c.eqNullSafe(F.lit(v)), i).otherwise(rank)
        out = [rank] if listed else []
        if op.options.get("reverse"):
            return [*[r.desc() for r in out], c.desc_nulls_last()]
        return [*[r.asc() for r in out], c.asc_nulls_first()]


def _flat(args: Any) -> list[Any]:
    return [x for a in args for x in (_flat(a) if isinstance(a, (list, tuple)) else [a])]


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [s for k in range(len(names) + 1) for s in itertools.combinations(names, k)]


def summ(
    ds: Dataset, *args: Any, weightcol: str | bool | None = None, filterexpr: str | None = None, filtername: str | None = None, nofilter: bool = False, zeros: bool = False,
    allcalc: bool = False, levels: list[int] | None = None, nomt: bool = False, proportions: bool = False, name: str | None = None, label: str = "", ordered: bool = True, now: Any = None,
) -> Dataset:
    """Summarise ds by condition columns (names or condcol) with measures.

    Without options, a row for each combination of the values present after the filter (null is a value);
    zeros=True takes the values before the filter. allcalc adds all marginals, with the column's all_value;
    levels=[k, ...] picks the groupings by so many columns; nomt drops marginal rows from the result.
    proportions adds, for every set of condition columns, the share of a row in the row where these are
    marginal, by weighted counts if there is a default weight. A multi-valued column counts a row once per distinct
    element, and marginals over it count rows once.

    Quantiles run jobs when summ is called, as many as it takes to narrow them down; all else is planned only.
    The result has _freq_, _level_, _type_, _condcols_, the condition columns and the measures, and is a
    Dataset weighted by _freq_. ordered=False leaves out the final sort.
    """
    args = _flat(args)
    if bad := [a for a in args if not isinstance(a, (str, condcol, Measure))]:
        raise TypeError(f"summ takes column names, condcol and measures, not {bad[0]!r}")
    source = ds.filter(filterexpr, filtername, nofilter, now)
    conditions = [_Condition(ds, a) for a in args if isinstance(a, (str, condcol))]
    names = [c.name for c in conditions]
    if len(set(names)) < len(names):
        raise ValueError("a condition column is given twice")
    default = ds.weight if weightcol is None else weightcol or None
    measures: dict[str, Measure] = {}
    for m in (a.settled(ds, default) for a in args if isinstance(a, Measure)):
        measures.setdefault(m.name(), m)
    by_name = {c.name: c for c in conditions}
    # Squares are summed about a value of the column: any finite one will do, so the first is asked for, once a column.
    centres: dict[str, float] = {}
    for m in measures.values():
        if m.centred and not source.df.isStreaming:
            if m.column not in centres:
                x = F.col(f"`{m.column}`").cast("double")
                first = source.df.where(F.abs(x) < 1e150).select(x).first()
                centres[m.column] = first[0] if first else 0.0
            m.centre = centres[m.column]

    n = len(names)
    if proportions or allcalc:
        sets = _subsets(names)
    elif levels is not None:
        sets = [s for s in _subsets(names) if len(s) in levels]
    else:
        sets = [tuple(names)]

    a = Aggregates()
    count = a.count("rows", F.lit(True))
    weighted = None
    if default and proportions:
        from tallyframe.operators.measures import freq

        weighted = next(iter(freq(weight=default).settled(ds, default).build(a).values()))
    closing: dict[str, Column] = {}
    ranks: dict[tuple, list[quantile]] = {}
    for m in measures.values():
        if isinstance(m, quantile):
            ranks.setdefault((m.column, m.weight, m.exclude), []).append(m)
            continue
        for k, e in m.build(a).items():
            if k in closing:
                raise ValueError(f"two measures give the column {k!r}")
            closing[k] = e

    used = {x for m in measures.values() for x in (m.column, m.weight) if x} | ({default} if weighted is not None else set())
    # Condition columns get names of their own, as a column may also be a measure or weight.
    keyed = source.df.select(*[by_name[c].row.alias(f"__c_{c}") for c in names], *[F.col(f"`{u}`") for u in sorted(used)])

    def exploded(multi: tuple[str, ...]) -> DataFrame:
        out = keyed
        for c in multi:
            out = out.withColumn(f"__c_{c}", F.explode(f"__c_{c}"))
        return out

    multis = [c.name for c in conditions if c.multi]
    bases: dict[tuple[str, ...], tuple[DataFrame, list[str]]] = {}
    for s in sets:
        key = tuple(c for c in multis if c in s)
        if key not in bases:
            needed = [c for c in names if (c in key or c not in multis) and any(c in t for t in sets if tuple(x for x in multis if x in t) == key)]
            bases[key] = exploded(key).groupBy(*[F.col(f"__c_{c}") for c in needed]).agg(*a.first()), needed

    # The quantiles of all groupings over the same multi-valued columns come from the same scans.
    found: list[tuple[set[int], DataFrame, list[str]]] = []
    for group in ranks.values():
        for key in bases:
            mine = [(i, [f"__c_{c}" for c in s]) for i, s in enumerate(sets) if tuple(c for c in multis if c in s) == key]
            columns = list(dict.fromkeys(n for m in group for n in m.closed([F.lit(0.0)] * len(m.targets(F.lit(1.0))), F.lit(1.0))))
            found.append(({i for i, _ in mine}, rank_values(exploded(key), mine, group), columns))
    quantile_columns = list(dict.fromkeys(n for *_, columns in found for n in columns))

    domain_df = _unfiltered(ds, by_name, names) if zeros else None
    tables = []
    for i, s in enumerate(sets):
        base, _ = bases[tuple(c for c in multis if c in s)]
        cells = base.groupBy(*[F.col(f"__c_{c}") for c in s]).agg(*a.again()) if s else base.agg(*a.again())
        if len(s) > 1 or (s and zeros):
            cells = _dense(cells, domain_df if zeros else None, s)
        cells = cells.withColumn("_freq_", F.coalesce(count, F.lit(0)).cast("bigint"))
        for numbers, values, columns in found:
            if i in numbers:
                here = values.where(F.col("__set") == i).select(*[F.col(f"__c_{c}").alias(f"__q_{c}") for c in s], *[F.col(f"`{n}`") for n in columns])
                cells = cells.join(here, [F.col(f"__c_{c}").eqNullSafe(F.col(f"__q_{c}")) for c in s] or F.lit(True), "left").drop(*[f"__q_{c}" for c in s])
        keys = [(F.col(f"__c_{c}") if c in s else F.lit(by_name[c].all_value).cast(by_name[c].kind)).alias(c) for c in names]
        tables.append(
            cells.select(
                *keys, "_freq_", F.lit(len(s)).alias("_level_"), F.lit("".join("1" if c in s else "0" for c in names)).alias("_type_"), F.array(*[F.lit(c) for c in s]).cast("array<string>").alias("_condcols_"),
                F.lit(i).alias("__set"), *[e.alias(k) for k, e in closing.items()], *[F.col(f"`{n}`") for n in quantile_columns], *([weighted.alias("__wfreq")] if weighted is not None else []),
            )
        )
    result = functools.reduce(DataFrame.unionByName, tables)
    shares = []
    if proportions:
        amount = F.col("__wfreq" if weighted is not None else "_freq_")
        for k in range(n, 0, -1):
            for m in itertools.combinations(names, k):
                column = "_prop_of_all-" + "-".join(m)
                shares.append(column)
                # Rows that share all but the columns of m meet the row in which these are marginal.
                cleared = F.concat(*[F.lit("0") if c in m else F.substring("_type_", j + 1, 1) for j, c in enumerate(names)])
                w = Window.partitionBy(cleared, *[F.col(f"`{c}`") for c in names if c not in m])
                result = result.withColumn(column, F.try_divide(amount, F.max(F.when(F.col("_type_") == cleared, amount)).over(w)).cast("double"))
    if nomt:
        result = result.where(F.col("_level_") == n)
    for i, c in enumerate(conditions):
        result = result.where(~((F.substring("_type_", i + 1, 1) == "1") & c.hidden))
    if ordered:
        result = result.orderBy("__set", *[e for c in conditions for e in c.sort])
    result = result.select(*names, "_freq_", "_level_", "_type_", "_condcols_", *[F.col(f"`{k}`") for k in [*closing, *quantile_columns, *shares]])
    columns = {c.name: c.meta for c in conditions} | {"_freq_": ColumnMeta("scalar", label="Frequency")}
    columns |= {c: ColumnMeta("identity") for c in ("_level_", "_type_", "_condcols_")} | {k: ColumnMeta("scalar") for k in [*closing, *quantile_columns, *shares]}
    return Dataset(result, name or _result_name(ds.name, names), columns, "_freq_", label, summary=True)


def _result_name(name: str, names: list[str]) -> str:
    return f"sumof_{name}" + ("_by_" + "_".join(names) if names else "")


def _unfiltered(ds: Dataset, by_name: dict[str, _Condition], names: list[str]) -> DataFrame:
    base = (ds.unfiltered if ds.unfiltered is not None else ds.df).select(*[by_name[c].row.alias(f"__c_{c}") for c in names])
    return base


def _dense(cells: DataFrame, domain: DataFrame | None, s: tuple[str, ...]) -> DataFrame:
    """cells with a row for every combination of the values of its keys (of `domain`, if given).

    The values of each key are gathered as a set: condition columns have few. The combinations are as
    many as the rows of the result.
    """
    of = cells if domain is None else domain
    sets = []
    for c in s:
        k = F.col(f"__c_{c}")
        if isinstance(of.schema[f"__c_{c}"].dataType, T.ArrayType):
            sets.append(F.transform(F.array_distinct(F.flatten(F.collect_set(k))), lambda v: F.struct(v.alias("v"))).alias(f"__v_{c}"))
        else:
            sets.append(F.collect_set(F.struct(k.alias("v"))).alias(f"__v_{c}"))
    full = of.agg(*sets)
    for c in s:
        full = full.withColumn(f"__d_{c}", F.explode(f"__v_{c}")).withColumn(f"__d_{c}", F.col(f"__d_{c}.v")).drop(f"__v_{c}")
    joined = full.join(cells, [F.col(f"__d_{c}").eqNullSafe(F.col(f"__c_{c}")) for c in s], "left")
    rest = [x for x in cells.columns if not x.startswith("__c_")]
    return joined.select(*[F.col(f"__d_{c}").alias(f"__c_{c}") for c in s], *rest)
