"""Readers: delimited and fixed-width text (plain, gzip or zip), databases, and loading of several sources."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyframe.sources.columns import SourceColumn, converted

Hook = Callable[[dict[str, Any]], dict[str, Any] | None]


def _skip_per_file(df: DataFrame, rows: int) -> DataFrame:
    """df without the first rows of every file; df has __file and __block, the start of the row's split.

    A split is read in order by one task, so a file's first rows are the first ones of its split at 0.
    """
    if not rows:
        return df.drop("__file", "__block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for f in frames:
            at_start = f["__block"] == 0
            number = f[at_start].groupby("__file").cumcount() + f.loc[at_start, "__file"].map(lambda k: seen.get(k, 0))
            for k, n in f.loc[at_start, "__file"].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield f.drop(index=number.index[number < rows]).drop(columns=["__file", "__block"])

    kept = T.StructType([x for x in df.schema.fields if x.name not in ("__file", "__block")])
    return df.mapInPandas(run, kept)


def _marked(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def _zip_parts(path: str) -> tuple[str, str]:
    """(archive, member) of a path like dir/x.zip/member; the member may be empty."""
    at = path.lower().find(".zip")
    return path[: at + 4], path[at + 5 :]


#: Rows of a zip member that are handed on at once.
ZIP_ROWS = 10_000


def _zip_rows(spark: SparkSession, path: str, member: str, skip: int, split: Callable[[Iterator[str]], Iterator[list[str]]], width: int, encoding: str = "UTF-8", errors: str = "strict") -> DataFrame:
    """Rows of text fields from the members of zip archives, one archive per task.

    A member is unpacked, decoded and split as it is read, ZIP_ROWS rows at a time. Bytes that the encoding does not
    have are an error, or with errors="replace" become the replacement character.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in [member] if member else [n for n in z.namelist() if not n.endswith("/")]:
                        with z.open(name) as raw, io.TextIOWrapper(raw, encoding=encoding, errors=errors, newline="") as lines:
                            rows = itertools.islice(split(lines), skip, None)
                            while chunk := list(itertools.islice(rows, ZIP_ROWS)):
                                yield pd.DataFrame({"f": [(r + [None] * width)[:width] for r in chunk]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "f array<string>")


def csv_source(spark: SparkSession, path: str, columns: list[SourceColumn], header: bool = False, header_rows: int = 0, missing: tuple[str, ...] = (), delimiter: str = ",", quote: str = '"', multiline: bool = True, encoding: str = "UTF-8", errors: str = "strict") -> DataFrame:
    """Delimited text: columns by position (ordinalpos), or by the names in the header line.

    Quoted fields may hold delimiters, doubled quotes and, with multiline, line ends; without multiline, files are
    split among tasks. Gzip is read as it is; zip archives, also as archive/member, one per task and member by member; errors
    (strict or replace) decides what bytes that are no text of the encoding do there. header_rows lines of every file are skipped.
    """
    width = 1 + max((c.ordinalpos or 0) - c.posbase for c in columns)
    if ".zip" in path.lower():
        archive, member = _zip_parts(path)

        def split(lines: Iterator[str]) -> Iterator[list[str]]:
            return csv.reader(lines, delimiter=delimiter, quotechar=quote)

        if header:
            raise ValueError("in zip archives, give positions and header_rows=1")
        rows = _zip_rows(spark, archive, member, header_rows, split, width, encoding, errors)
        return rows.select(*[converted(F.get("f", F.lit(c.ordinalpos - c.posbase)), c, missing) for c in columns])
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("multiLine", multiline).option("encoding", encoding).option("mode", "PERMISSIVE")
    if header:
        rows = reader.option("header", True).csv(path)
        return rows.select(*[converted(F.col(f"`{c.source_name}`"), c, missing) for c in columns])
    if any(c.ordinalpos is None for c in columns):
        raise ValueError("every column needs an ordinalpos")
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width)])
    rows = reader.schema(schema).csv(path)
    if header_rows:
        rows = _skip_per_file(_marked(rows), header_rows)
    return rows.select(*[converted(F.col(f"f{c.ordinalpos - c.posbase}"), c, missing) for c in columns])


def fixed_width_source(spark: SparkSession, path: str, columns: list[SourceColumn], header_rows: int = 0, missing: tuple[str, ...] = (), blank: str | None = None) -> DataFrame:
    """Fixed-width text: startpos and length of each column; blank fields take the text `blank`, or none.

    Control-Z and carriage returns at line ends are dropped.
    """
    if any(c.startpos is None or c.length is None for c in columns):
        raise ValueError("every column needs startpos and length")
    if ".zip" in path.lower():
        archive, member = _zip_parts(path)
        lines = _zip_rows(spark, archive, member, header_rows, lambda lines: ([x.rstrip("\r\n")] for x in lines), 1).select(F.get("f", F.lit(0)).alias("value"))
    else:
        lines = spark.read.text(path)
        lines = _skip_per_file(_marked(lines), header_rows) if header_rows else lines
    line = F.regexp_replace("value", r"[\r\x1a]+$", "")
    lines = lines.select(line.alias("value")).where(F.col("value") != "")
    field = lambda c: F.trim(F.substring("value", c.startpos - c.posbase + 1, c.length))
    return lines.select(*[converted(F.when(field(c) == "", F.lit(blank)).otherwise(field(c)), c, missing) for c in columns])


def jdbc_source(spark: SparkSession, url: str, table: str, columns: list[SourceColumn] | None = None, where: str | None = None, fetchcount: int = 1000, **options: str) -> DataFrame:
    """A table by JDBC; filters and columns are pushed into the database. Give partitionColumn, lowerBound,
    upperBound and numPartitions to read in parallel."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetchcount), **options).load()
    if where:
        df = df.where(where)
    return df.select(*[F.col(f"`{c.source_name}`").alias(c.name) for c in columns]) if columns else df


def dbapi_source(spark: SparkSession, connect: Callable[[], Any], table: str, columns: list[SourceColumn], schema: str, where: str = "", whereargs: tuple = (), partitions: list[str] | None = None, fetchcount: int = 1000) -> DataFrame:
    """A table by any DB-API driver. connect is called on the executors; columns and conditions go to the database.

    partitions: conditions that divide the table; each is read by a task of its own, fetchcount rows at a time.
    """
    names = ", ".join(c.source_name for c in columns)
    heads = [c.name for c in columns]
    parts = spark.createDataFrame([(p,) for p in partitions or [""]], "cond string").repartition(len(partitions or [""]), "cond")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cond in f["cond"]:
                conds = " and ".join(f"({x})" for x in (where, cond) if x)
                db = connect()
                cur = db.cursor()
                cur.execute(f"select {names} from {table}" + (f" where {conds}" if conds else ""), whereargs)
                while rows := cur.fetchmany(fetchcount):
                    yield pd.DataFrame(rows, columns=heads)
                db.close()

    return parts.mapInPandas(run, schema)


def with_hook(df: DataFrame, hook: Hook, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows passed through a function of dicts, which may change a row or drop it by returning None.

    Prefer expressions; this is for logic that has none. Rows are handled in Arrow batches.
    """
    out = schema or df.schema
    names = out.fieldNames() if isinstance(out, T.StructType) else T._parse_datatype_string(out).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            clean = f.astype(object).where(f.notna(), None)
            kept = [r for r in map(hook, clean.to_dict("records")) if r is not None]
            yield pd.DataFrame([[r.get(n) for n in names] for r in kept], columns=names)

    return df.mapInPandas(run, out)


def load(*sources: DataFrame, rowlimit: int | None = None) -> DataFrame:
    """The rows of several sources one after the other; columns a source lacks are null. rowlimit: per source."""
    limited = [s.limit(rowlimit) if rowlimit is not None else s for s in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), limited)
