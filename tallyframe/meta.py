"""Datasets: a DataFrame with declared column roles, labels, missing codes and a default weight.

The plan stays lazy; a Dataset only carries what the DataFrame schema cannot say.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

DISCRETE, SCALAR = ("categorical", "ordinal"), ("scalar", "weighting")
ROLES = (*DISCRETE, *SCALAR, "identity", "searchabletext", "row_ordinal")
NAME = re.compile(r"^[a-z_-][a-z0-9_$-]*$", re.IGNORECASE)


class RoleError(ValueError):
    """A column is used in a way its role does not allow."""


def _labelled(label: Callable[[Any], str], c: Column, whole: bool) -> Column:
    """label(value) of a column, called once for each distinct value of a batch."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            codes, values = pd.factorize(v, use_na_sentinel=False)
            # Whole numbers with nulls among them arrive as doubles.
            texts = [label(None if pd.isna(x) else int(x) if whole else x.item() if hasattr(x, "item") else x) for x in values]
            yield pd.Series([None if t is None else str(t) for t in texts], dtype=object).take(codes).reset_index(drop=True)

    return F.pandas_udf(run, "string")(c)


@dataclass(frozen=True)
class ColumnMeta:
    """What a dataset knows about a column.

    role: one of ROLES ("noncategorical" means identity). labels: dict or callable applied on output only.
    missing: values that stand for null. all_value, all_label: mark marginal rows.
    fmt: printf format of numbers or Spark pattern of dates, used by prefix operators and printing.
    """

    role: str = ""
    label: str = ""
    desc: str = ""
    labels: dict | Callable[[Any], Any] | None = None
    missing: tuple = ()
    all_value: Any = None
    all_label: str = "All"
    fmt: str = ""
    ignore_none: bool = True

    def __post_init__(self) -> None:
        role = "identity" if self.role == "noncategorical" else self.role
        object.__setattr__(self, "role", role)
        if role and role not in ROLES:
            raise RoleError(f"unknown column role {self.role!r}")


def default_role(kind: T.DataType) -> str:
    """The role of a column for which none is declared: strings, whole numbers and arrays are
    categorical, dates and times ordinal, other numbers and timestamps scalar."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType)):
        return "scalar"
    return "ordinal" if isinstance(kind, T.DateType) or type(kind).__name__ == "TimeType" else "categorical"


def default_all_value(kind: T.DataType) -> Any:
    """The sentinel of marginal rows; _level_ and _type_ tell them apart for certain."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return -(2 ** (8 * {"tinyint": 1, "smallint": 2, "int": 4}[kind.simpleString()] - 1)) + 1
    if isinstance(kind, T.LongType):
        return -(2**63) + 1
    return "_all_" if isinstance(kind, T.StringType) else None


@dataclass(frozen=True)
class Dataset:
    """A named DataFrame with column metadata. Every operation returns a new Dataset."""

    df: DataFrame
    name: str = "dataset"
    columns: dict[str, ColumnMeta] = field(default_factory=dict)
    weight: str | None = None
    label: str = ""
    filters: dict[str, str] = field(default_factory=dict)
    filtered_by: tuple[str, ...] = ()
    unfiltered: DataFrame | None = None
    summary: bool = False

    def __post_init__(self) -> None:
        if not NAME.match(self.name):
            raise ValueError(f"bad dataset name {self.name!r}")
        for c in self.columns:
            if c not in self.df.columns:
                raise ValueError(f"no column {c!r}")

    @staticmethod
    def of(df: DataFrame, name: str = "dataset", weight: str | None = None, label: str = "", **columns: ColumnMeta) -> Dataset:
        """Apply missing codes and empty-array defaults, and wrap."""
        changed = {}
        for c, m in columns.items():
            kind = df.schema[c].dataType
            e = F.col(f"`{c}`")
            if isinstance(kind, T.ArrayType):
                e = F.coalesce(e, F.array().cast(kind))
                if m.ignore_none:
                    e = F.array_compact(e)
                changed[c] = e
            elif m.missing:
                changed[c] = F.when(~e.isin([v for v in m.missing if v is not None]), e)
        return Dataset(df.withColumns(changed) if changed else df, name, columns, weight, label)

    def meta(self, column: str) -> ColumnMeta:
        m = self.columns.get(column, ColumnMeta())
        return m if m.role else replace(m, role=default_role(self.kind(column)))

    def kind(self, column: str) -> T.DataType:
        try:
            return self.df.schema[column].dataType
        except KeyError:
            raise ValueError(f"dataset {self.name!r} has no column {column!r}") from None

    def is_discrete(self, column: str) -> bool:
        return self.meta(column).role in DISCRETE

    def is_scalar(self, column: str) -> bool:
        return self.meta(column).role in SCALAR

    def all_value(self, column: str) -> Any:
        m = self.meta(column)
        kind = self.kind(column)
        return m.all_value if m.all_value is not None else default_all_value(kind.elementType if isinstance(kind, T.ArrayType) else kind)

    # -- projections
    def select(self, *names: str) -> Dataset:
        return replace(self, df=self.df.select(*[F.col(f"`{n}`") for n in names]), columns={n: m for n, m in self.columns.items() if n in names})

    def drop(self, *names: str) -> Dataset:
        return self.select(*[c for c in self.df.columns if c not in names])

    def rename(self, old: str, new: str) -> Dataset:
        return replace(self, df=self.df.withColumnRenamed(old, new), columns={new if n == old else n: m for n, m in self.columns.items()})

    def derive(self, name: str, expression: Column, meta: ColumnMeta | None = None) -> Dataset:
        """Add or replace a column. Prefer built-in expressions; a pandas_udf of columns is a Column too."""
        if not NAME.match(name):
            raise ValueError(f"bad column name {name!r}")
        return replace(self, df=self.df.withColumn(name, expression), columns=self.columns | {name: meta or ColumnMeta()})

    def fill_missing(self, name: str, expression: Column) -> Dataset:
        """Compute a value where it is missing (null), then apply the missing codes again."""
        e = F.coalesce(F.col(f"`{name}`"), expression)
        codes = [v for v in self.meta(name).missing if v is not None]
        return replace(self, df=self.df.withColumn(name, F.when(~e.isin(codes), e) if codes else e))

    def zip_columns(self, name: str, sources: Iterable[str], meta: ColumnMeta | None = None) -> Dataset:
        """One multi-valued column from several; nulls are dropped from it."""
        return self.derive(name, F.array_compact(F.array(*[F.col(f"`{s}`") for s in sources])), meta or ColumnMeta("categorical"))

    # -- output
    def translated(self, *names: str) -> DataFrame:
        """Columns as they are shown: the marker of marginal rows, then labels, then the value's text."""
        out = []
        for n in names or self.df.columns:
            m, c = self.meta(n), F.col(f"`{n}`")
            shown = c
            if isinstance(m.labels, dict) and m.labels:
                pairs = [F.lit(x) for k, v in m.labels.items() if k is not None for x in (str(k), str(v))]
                shown = F.coalesce(F.create_map(*pairs)[c.cast("string")] if pairs else F.lit(None), c.cast("string"))
                if None in m.labels:
                    shown = F.coalesce(shown, F.lit(str(m.labels[None])))
            elif callable(m.labels):
                shown = _labelled(m.labels, c, isinstance(self.kind(n), T.IntegralType))
            if self.summary and (a := self.all_value(n)) is not None and m.role in DISCRETE and not isinstance(self.kind(n), T.ArrayType):
                shown = F.when(c == F.lit(a), F.lit(m.all_label)).otherwise(shown.cast("string"))
            out.append(shown.alias(n))
        return self.df.select(*out)

    def text(self, *names: str, rows: int = 20) -> str:
        """The first rows as a text table, the header on top; numbers to the right."""
        names = names or tuple(c for c in self.df.columns if c not in ("_level_", "_type_", "_condcols_"))
        shown = [["" if v is None else str(v) for v in r] for r in self.translated(*names).limit(rows).collect()]
        heads = [self.meta(n).label or n for n in names]
        width = [max(map(len, [h, *[r[i] for r in shown]])) for i, h in enumerate(heads)]
        right = [isinstance(self.kind(n), T.NumericType) and not self.meta(n).labels for n in names]
        lines = [[h.ljust(w) for h, w in zip(heads, width)], ["-" * w for w in width]]
        lines += [[v.rjust(w) if r else v.ljust(w) for v, w, r in zip(row, width, right)] for row in shown]
        return "\n".join(" ".join(x).rstrip() for x in lines)

    def describe(self, detail: int = 1) -> DataFrame:
        """One row per column: name, type, role, label and, with detail above 1, the description."""
        spark = self.df.sparkSession
        rows = [(n, self.kind(n).simpleString(), self.meta(n).role, self.meta(n).label or n, self.meta(n).desc if detail > 1 else "") for n in self.df.columns]
        return spark.createDataFrame(rows, "column_name string, datatype string, role string, label string, description string")

    # -- filters
    def filter(self, expr: str | None = None, name: str | None = None, nofilter: bool = False, now: Any = None) -> Dataset:
        """Rows for which a filter expression, or the named filter, holds; filters on filters combine."""
        from tallyframe.plans.predicate import to_column

        if nofilter or (expr is None and name is None):
            return self
        text = self.filters[name] if expr is None else expr
        return replace(self, df=self.df.where(to_column(text, self, now=now)), filtered_by=(*self.filtered_by, text), unfiltered=self.unfiltered if self.unfiltered is not None else self.df)

    def make_filter(self, name: str, expr: str) -> Dataset:
        """Keep a filter by name. It is stored as text and planned anew on use, so it never goes stale."""
        from tallyframe.plans.predicate import parse

        parse(expr)
        return replace(self, filters=self.filters | {name: expr})

    def drop_filter(self, name: str) -> Dataset:
        return replace(self, filters={k: v for k, v in self.filters.items() if k != name})

    def summ(self, *args: Any, **options: Any) -> Dataset:
        from tallyframe.operators.summarise import summ

        return summ(self, *args, **options)

    # -- metadata as text
    def meta_json(self) -> str:
        kept = {n: {k: v for k, v in asdict(m).items() if not callable(v)} for n, m in self.columns.items()}
        for m in kept.values():
            if isinstance(m.get("labels"), dict):
                m["labels"] = [[k, v] for k, v in m["labels"].items()]
        return json.dumps({"name": self.name, "label": self.label, "weight": self.weight, "filters": self.filters, "columns": kept}, default=str)

    @staticmethod
    def from_json(df: DataFrame, text: str) -> Dataset:
        d = json.loads(text)
        columns = {}
        for n, m in d["columns"].items():
            if m.get("labels"):
                m["labels"] = {k: v for k, v in m["labels"]}
            columns[n] = ColumnMeta(**m | {"missing": tuple(m["missing"])})
        return Dataset(df, d["name"], columns, d["weight"], d["label"], d["filters"])
