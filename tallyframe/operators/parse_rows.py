"""Separate delimited text records that cannot become typed rows, with the reason, from those that can.

A record is comma-separated; a field may be enclosed in double quotes, with white space (blank, tab,
CR, LF) allowed outside them and "" for a quote inside. Everything is built-in expressions:

1. `from_csv` reads every record permissively under the explicit schema and keeps the corrupt text.
2. A record that was read and has the strict shape (three plain or quoted runs of digits, in range)
   is done.
3. All others are reclassified from their raw text: the text is cut at its quotes, so pieces at odd
   positions are inside quotes and those at even positions outside. Pieces outside show wrong
   quoting, commas outside give the column count, then each field is checked and cast. A record
   that passes all checks is a valid row, whatever the permissive reader made of it.

The work per record is linear in its length and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WS = r"[ \t\r\n]"


@dataclass(frozen=True)
class IntField:
    """A whole-number column in [low, high]; high has at most 18 digits."""

    name: str
    low: int
    high: int


STDPOP_FIELDS = (IntField("agegrp", 1, 18), IntField("sex", 1, 2), IntField("pop", 0, 2_000_000_000))


def _whole(text: Column) -> Column:
    """The value of a run of ASCII digits, null if it is no such run or too long to be in any range."""
    bare = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^0+(?=[0-9])", "")
    return F.when(bare.rlike(r"^[0-9]{1,18}$") & (F.length(bare) <= 18) & ~bare.contains("\n"), bare).try_cast("bigint")


def classify(df: DataFrame, raw: str, fields: tuple[IntField, ...]) -> DataFrame:
    """df with `reason` (null for a valid record) and `values` (a struct of the typed fields).

    reason is the first that applies of: blank (null, or nothing but white space), quoting,
    column_count, then the name of the first field that is not a whole number in its range.
    Clashing columns of df named reason or values are replaced.
    """
    schema = ", ".join(f"{f.name} bigint" for f in fields) + ", __corrupt string"
    text = F.col(f"`{raw}`")
    read = F.from_csv(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    plain = rf'{WS}*+(?:[0-9]{{1,18}}|"[0-9]{{1,18}}"){WS}*+'
    strict = "^" + ",".join([plain] * len(fields)) + r"\z"
    out = df.drop("reason", "values").withColumn("__read", read)
    in_range = F.lit(True)
    for f in fields:
        in_range = in_range & F.col(f"__read.{f.name}").between(f.low, f.high)
    # Columns, not expressions: what is used more than once is worked out once. Clean records have no pieces and no parts.
    out = out.withColumn("__clean", F.coalesce(F.col("__read.__corrupt").isNull() & text.rlike(strict) & in_range, F.lit(False)))
    clean, pieces = F.col("__clean"), F.col("__pieces")
    out = out.withColumn("__pieces", F.when(~clean, F.split(text, '"', -1)))
    # The first and last piece are taken out, so that no lambda over the others depends on their number:
    # it would be worked out again for each of them.
    out = out.withColumns({"__first": F.get(pieces, F.lit(0)), "__end": F.element_at(pieces, -1), "__inner": F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))})
    inner = F.col("__inner")
    outside_ok = F.forall(F.transform(inner, lambda s, i: (i % 2 == 0) | (s == "") | s.rlike(rf"(?s)^{WS}*,(?:.*,)?{WS}*\z")), lambda ok: ok)
    ends_ok = (F.size(pieces) == 1) | (F.col("__first").rlike(rf"(?s)^(?:.*,)?{WS}*\z") & F.col("__end").rlike(rf"(?s)^{WS}*(?:,.*)?\z"))
    quoting = (F.size(pieces) % 2 == 0) | ~outside_ok | ~ends_ok
    # Inside quotes a comma or a doubled quote can be no part of a number: both become a letter.
    flat_inner = F.transform(inner, lambda s, i: F.when(i % 2 == 0, F.translate(s, ",", "x")).when(s == "", "x").otherwise(s))
    flat = F.when(F.size(pieces) == 1, text).otherwise(F.concat("__first", F.array_join(flat_inner, ""), "__end"))
    out = out.withColumns({"__quoting": F.when(~clean, quoting), "__parts": F.when(~clean, F.split(flat, ",", -1))})
    # More fields than there are columns are counted, not read.
    out = out.withColumn("__whole", F.when(F.size("__parts") == len(fields), F.transform("__parts", _whole)))
    reason = (
        F.when(clean, F.lit(None).cast("string"))
        .when(text.isNull() | text.rlike(rf"^{WS}*\z"), "blank")
        .when(F.col("__quoting"), "quoting")
        .when(F.size("__parts") != len(fields), "column_count")
    )
    for i, f in enumerate(fields):
        v = F.get("__whole", F.lit(i))
        reason = reason.when(~F.coalesce(v.between(f.low, f.high), F.lit(False)), f.name)
    values = F.struct(*[F.when(clean, F.col(f"__read.{f.name}")).otherwise(F.get("__whole", F.lit(i))).alias(f.name) for i, f in enumerate(fields)])
    # Out of a generator: a condition on the reason is then asked of the result, and not of its whole expression once more.
    out = out.withColumn("__result", F.explode(F.array(F.struct(reason.alias("reason"), values.alias("values")))))
    out = out.withColumn("reason", F.col("__result.reason")).withColumn("values", F.col("__result.values"))
    return out.drop("__result", "__read", "__clean", "__pieces", "__first", "__end", "__inner", "__quoting", "__parts", "__whole")


def records(raw: DataFrame) -> DataFrame:
    """All records but the headers (line_no 1); a null line_no is no header."""
    return raw.where(~F.coalesce(F.col("line_no") == 1, F.lit(False)))


def rejected_rows(raw: DataFrame, fields: tuple[IntField, ...] = STDPOP_FIELDS) -> DataFrame:
    """line_id, reason of every record that cannot become a row; blank and null lines are no records."""
    marked = classify(records(raw), "raw_line", fields)
    return marked.where(F.col("reason").isNotNull() & (F.col("reason") != "blank")).select("line_id", "reason")


def typed_rows(raw: DataFrame, fields: tuple[IntField, ...] = STDPOP_FIELDS) -> DataFrame:
    """line_id and the typed fields of every valid record."""
    marked = classify(records(raw), "raw_line", fields)
    return marked.where(F.col("reason").isNull()).select("line_id", *[F.col(f"values.{f.name}").cast("bigint").alias(f.name) for f in fields])
