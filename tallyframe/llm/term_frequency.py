"""Rows and records of every distinct value, by heavy-light aggregation.

1. One scan detects the heavy terms of every field, and heavy records, with a mergeable frequent-item
   summary: whatever holds more than `support` of the rows is among them, and they are at most about
   1 / support a field, so their lists have a bound that does not grow with the data.
2. Rows are shuffled once, by record: a row carries all its fields, heavy terms as small numbers found by
   a broadcast of their list. Rows of a heavy record, and rows without a record, are spread over all tasks.
3. Each task walks its rows sorted by record, so repeated terms of a record show without a table of all
   records. Heavy terms are added up in exact local counter arrays; a task sends one row per heavy term.
   Light terms are combined batch by batch.
4. Only the remaining, light terms are shuffled by term, combined map-side first; both tables are united.
   What heavy records hold is sent as (term, heavy record), of which a term has a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.plans.scale import cut

#: Share of the rows from which a record is heavy.
RECORD_SUPPORT = 0.02


def heavy_terms(terms: DataFrame, columns: list[str], support: float) -> list[list]:
    """Per column a list, of at most a few times 1 / support values, that holds every value above support."""
    row = terms.select(*columns).stat.freqItems(columns, support).first()
    return [sorted(t for t in (row[i] or []) if t is not None) for i in range(len(columns))]


_COUNTS = "f int, slot int, t string, hot int, n bigint, r bigint"
_KIND = pa.schema([("f", pa.int32()), ("slot", pa.int32()), ("t", pa.string()), ("hot", pa.int32()), ("n", pa.int64()), ("r", pa.int64())])


def _runs(record: pa.Array) -> np.ndarray:
    """A number for each row that is the same for equal neighbours and rises otherwise."""
    change = np.zeros(len(record), np.int64)
    change[1:] = pc.fill_null(pc.not_equal(record.slice(1), record.slice(0, len(record) - 1)), True).to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def _first_of_run(run: np.ndarray, repeated: np.ndarray, code: np.ndarray) -> np.ndarray:
    """True at the first row of each (run, code); repeated: the rows whose run has several."""
    out = np.ones(len(run), bool)
    if len(repeated):
        r, c = run[repeated], code[repeated]
        order = np.lexsort((c, r))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (r[order][1:] != r[order][:-1]) | (c[order][1:] != c[order][:-1])
        out[repeated[order]] = fresh
    return out


class _Counter:
    """The counts of one task. Rows come sorted by record, so what a batch leaves open is its last record.

    A row has its record, `hot` (0 for usual records, k for the k-th heavy one, -1 without a record), and per field a
    heavy slot or a light term.
    """

    def __init__(self, slots: list[int]) -> None:
        self.slots = slots
        self.rows = [np.zeros(k + 1, np.int64) for k in slots]
        self.records = [np.zeros(k + 1, np.int64) for k in slots]
        self.all_records = 0
        # (field, heavy slot or light term) of the open record and, for each heavy record, of all that was seen.
        self.open: object = None
        self.seen: set = set()
        self.hot_seen: dict[tuple, int] = {}
        self.hot_records: set[int] = set()

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        run = _runs(b.column(0))
        hot = b.column(1).to_numpy(zero_copy_only=False)
        usual = hot == 0
        repeated = np.flatnonzero(np.bincount(run)[run] > 1)
        last = b.column(0)[n - 1].as_py() if usual[n - 1] else None
        carried = bool(usual[0]) and self.open is not None and b.column(0)[0].as_py() == self.open
        first_run = 0 if carried else -2
        if not carried:
            self.seen = set()
        self.all_records += int((_first_of_run(run, repeated, np.zeros(n, np.int64)) & usual).sum()) - int(carried)
        self.hot_records |= set(np.unique(hot[hot > 0]).tolist())
        still_open: set = set(self.seen) if carried and last is not None and run[n - 1] == first_run else set()
        for i, top in enumerate(self.slots):
            slot, term = b.column(2 + 2 * i), b.column(3 + 2 * i)
            s = pc.fill_null(slot, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(term)
            light = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.where(s > 0, s, np.where(light >= 0, top + 1 + light, 0))
            held = code > 0
            value = lambda k: ("s", int(k)) if k <= top else ("t", words.dictionary[int(k) - top - 1].as_py())  # noqa: B023, E731
            fresh = _first_of_run(run, repeated, code) & held & (hot != -1)
            if carried:
                for at in np.flatnonzero(fresh & (run == first_run)).tolist():
                    fresh[at] = (i, *value(code[at])) not in self.seen
            if last is not None:
                still_open |= {(i, *value(k)) for k in np.unique(code[held & (run == run[n - 1])]).tolist()}
            size = top + 1 + len(words.dictionary)
            rows = np.bincount(code[held], minlength=size)
            records = np.bincount(code[fresh & usual], minlength=size)
            self.rows[i] += rows[: top + 1]
            self.records[i] += records[: top + 1]
            for at in np.flatnonzero(fresh & (hot > 0)).tolist():
                self.hot_seen[i, *value(code[at]), int(hot[at])] = 1
            some = np.flatnonzero(rows[top + 1 :])
            if len(some):
                yield self._light(i, words.dictionary.take(pa.array(some)), rows[top + 1 :][some], records[top + 1 :][some])
        self.open, self.seen = last, still_open
        if len(self.hot_seen) > 100_000:
            yield self._hot()

    def _light(self, i: int, terms: pa.Array, rows: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
        k = len(terms)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.nulls(k, pa.int32()), terms, pa.nulls(k, pa.int32()), pa.array(rows), pa.array(records)], schema=_KIND)

    def _hot(self) -> pa.RecordBatch:
        keys = list(self.hot_seen)
        self.hot_seen = {}
        f, kind, v, h = zip(*keys)
        slots = pa.array([x if k == "s" else None for k, x in zip(kind, v)], pa.int32())
        terms = pa.array([x if k == "t" else None for k, x in zip(kind, v)], pa.string())
        zero = pa.array(np.zeros(len(keys), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), slots, terms, pa.array(h, pa.int32()), zero, zero], schema=_KIND)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.hot_seen:
            yield self._hot()
        out = [(i, k, None, None, int(self.rows[i][k]), int(self.records[i][k])) for i in range(len(self.slots)) for k in range(1, self.slots[i] + 1) if self.rows[i][k]]
        out += [(-1, 0, None, h, 0, 0) for h in sorted(self.hot_records)] + [(-1, 0, None, None, 0, self.all_records)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KIND.types)], schema=_KIND)


def term_frequency(df: DataFrame, record: str, fields: dict[str, Column], rare_below: int = 5, common_above: float = 0.05, support: float = 0.01) -> DataFrame:
    """field_name, field_value, n_rows, n_records, mark (rare, common or null) of every distinct value.

    fields maps a name to a string expression; null is no value and is not counted. Rows with a null
    record count in n_rows but are no record. mark is rare for fewer than rare_below distinct records,
    common for more than common_above of all distinct records of df (values or not). An empty table
    gives no rows.
    """
    spark, names = df.sparkSession, list(fields)
    cols = [f"t{i}" for i in range(len(names))]
    terms = df.select(F.col(f"`{record}`").alias("rec"), *[e.cast("string").alias(c) for c, e in zip(cols, fields.values())])
    heavy = heavy_terms(terms, cols, support)
    hot_records = heavy_terms(terms, ["rec"], RECORD_SUPPORT)[0]

    out = terms
    for i, c in enumerate(cols):
        if heavy[i]:
            # At most a few times 1 / support rows.
            known = spark.createDataFrame(pa.table({f"h{i}": pa.array(heavy[i], pa.string()), f"s{i}": pa.array(range(1, len(heavy[i]) + 1), pa.int32())}))
            out = out.join(F.broadcast(known), F.col(c) == F.col(f"h{i}"), "left").drop(f"h{i}").withColumn(c, F.when(F.col(f"s{i}").isNull(), F.col(c)))
        else:
            out = out.withColumn(f"s{i}", F.lit(None).cast("int"))
    hot = F.lit(0)
    for k, v in enumerate(hot_records):
        hot = F.when(F.col("rec") == F.lit(v), k + 1).otherwise(hot)
    if hot_records:
        # Asked of a set first: few rows go through the list.
        hot = F.when(F.col("rec").isin(hot_records), hot).otherwise(0)
    out = out.withColumn("hot", F.when(F.col("rec").isNull(), -1).otherwise(hot).cast("int"))
    # Without a record, or of a heavy one, a row goes anywhere; the id depends on its place in the input only.
    anywhere = F.when(F.col("hot") != 0, F.monotonically_increasing_id())
    by_record = out.withColumn("__spread", anywhere).repartition("__spread", F.when(F.col("hot") == 0, F.col("rec"))).sortWithinPartitions("hot", "rec")
    by_record = by_record.select("rec", "hot", *[x for i, c in enumerate(cols) for x in (f"s{i}", c)])
    sizes = [len(h) for h in heavy]

    def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sizes)
        for b in batches:
            if b.num_rows:
                yield from counter.add(b)
        yield from counter.close()

    parts = by_record.mapInArrow(local_counts, _COUNTS)
    # The heavy records of a term as bits, of which there are no more than heavy records: numbers, so that the sums stay in a hash table.
    bits = [F.bit_or(F.expr(f"if(hot between {k + 1} and {k + 62}, shiftleft(1L, hot - {k + 1}), 0L)")) for k in range(0, len(hot_records), 62)]
    n_records = reduce(lambda x, y: x + F.bit_count(y), bits, F.sum("r"))
    counted = cut(parts.groupBy("f", "slot", "t").agg(F.sum("n").alias("n_rows"), n_records.cast("bigint").alias("n_records")))
    # The total sits in one row of the result: it is broadcast as one row, not collected.
    total = counted.where("f = -1").agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("__all"))
    joined = counted.where("f >= 0").crossJoin(F.broadcast(total))
    listed = F.array(*[F.array(*[F.lit(t) for t in h]).cast("array<string>") for h in heavy])
    value = F.coalesce("t", F.get(F.get(listed, F.col("f")), F.col("slot") - 1))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") / F.col("__all") > common_above, "common")
    return joined.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("f")).alias("field_name"), value.alias("field_value"), "n_rows", "n_records", mark.alias("mark"))
