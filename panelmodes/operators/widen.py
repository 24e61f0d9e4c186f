"""Attribute-value rows into wide tables through an RDD ``combineByKey`` of slot registers."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmodes.functions.dates import month_index, month_of_index
from panelmodes.functions.labels import CATEGORIES
from panelmodes.session import shuffle_width


@dataclass(frozen=True)
class Merger:
    """How a cell settles several readings: ``lift`` one (rank, value), ``merge`` two states, ``lower`` to the value.

    ``merge`` must be associative and commutative and its state must stay bounded, so that it can run
    on the map side as well as after the shuffle.
    """

    lift: Callable[[tuple, Any], Any]
    merge: Callable[[Any, Any], Any]
    lower: Callable[[Any], Any]


def _latest_value(state: tuple) -> Any:
    return state[1]


MERGERS: dict[str, Merger] = {
    "latest": Merger(lambda rank, v: (rank, v), max, _latest_value),
    "earliest": Merger(lambda rank, v: (rank, v), min, _latest_value),
    "sum": Merger(lambda rank, v: v, lambda a, b: a + b, lambda s: s),
    "min": Merger(lambda rank, v: v, min, lambda s: s),
    "max": Merger(lambda rank, v: v, max, lambda s: s),
    "count": Merger(lambda rank, v: 1, lambda a, b: a + b, lambda s: s),
    "mean": Merger(lambda rank, v: (v, 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1]),
}


def _to_bool(v: Any) -> bool | None:
    text = str(v).strip().lower()
    return True if text in ("true", "1", "yes", "t") else False if text in ("false", "0", "no", "f") else None


def _or_none(kind: Callable[[Any], Any]) -> Callable[[Any], Any]:
    def encode(v: Any) -> Any:
        try:
            return kind(v)
        except (TypeError, ValueError, OverflowError):
            return None

    return encode


ENCODERS: dict[str, tuple[T.DataType, Callable[[Any], Any]]] = {
    "double": (T.DoubleType(), _or_none(float)),
    "long": (T.LongType(), _or_none(int)),
    "string": (T.StringType(), _or_none(str)),
    "boolean": (T.BooleanType(), _to_bool),
    "date": (T.DateType(), lambda v: v if isinstance(v, datetime.date) else _or_none(datetime.date.fromisoformat)(v)),
}


def _listed(column: pa.Array) -> list:
    """Python values of an Arrow column, numbers without nulls by the short way."""
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


@dataclass(frozen=True)
class Slot:
    """One column of the wide table: its name, type (a key of ENCODERS) and merger (a key of MERGERS)."""

    name: str
    kind: str = "double"
    merger: str = "latest"


def widen(cells: DataFrame, keys: Sequence[str], slot: str, value: str, slots: Sequence[Slot], rank: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """One row per entity key with one typed column per slot.

    ``cells`` has the key columns, the INT position ``slot`` of the attribute in ``slots``, the ``value``
    and the ``rank`` columns by which 'latest' and 'earliest' choose (ties on the rank: the larger,
    or smaller, value; NULL ranks before everything). Rows whose slot is NULL or out of range, or whose value is NULL, fill no cell and
    make no row. Keys may be NULL and then form an entity of their own. A value that the slot's type can't hold
    becomes NULL. An empty input gives an empty table with the full schema.

    Every entity holds one register per slot, so a combiner's size depends on the number of slots and not
    on the number of rows: an entity with a third of all rows shrinks to one register list per map task.
    """
    n, k, r = len(slots), len(keys), len(rank)
    lifts = [MERGERS[s.merger].lift for s in slots]
    merges = [MERGERS[s.merger].merge for s in slots]
    lowers = [MERGERS[s.merger].lower for s in slots]
    encoders = [ENCODERS[s.kind][1] for s in slots]

    loose = any(cells.schema[c].nullable for c in rank)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])

    def cells_of(row: tuple) -> Iterator[tuple]:
        for batch in pa.ipc.open_stream(row[0]):
            plain = [_listed(c) for c in batch.columns]
            keyed = zip(*plain[:k])
            ranked = zip(*plain[k + 1 : k + 1 + r]) if r else repeat(())
            if loose:
                ranked = (tuple((0,) if x is None else (1, x) for x in place) for place in ranked)
            for key, at, place, v in zip(keyed, plain[k], ranked, plain[-1]):
                yield key, (at, lifts[at](place, v))

    def create(cell: tuple) -> list:
        registers = [None] * n
        registers[cell[0]] = cell[1]
        return registers

    def absorb(registers: list, cell: tuple) -> list:
        at, state = cell
        old = registers[at]
        registers[at] = state if old is None else merges[at](old, state)
        return registers

    def join(one: list, two: list) -> list:
        for at, state in enumerate(two):
            if state is not None:
                old = one[at]
                one[at] = state if old is None else merges[at](old, state)
        return one

    def emit(pair: tuple) -> tuple:
        return (*pair[0], *(None if s is None else encoders[i](lowers[i](s)) for i, s in enumerate(pair[1])))

    typed = {f.name: f.dataType for f in cells.schema}
    schema = T.StructType([*(T.StructField(c, typed[c]) for c in keys), *(T.StructField(s.name, ENCODERS[s.kind][0]) for s in slots)])
    rows = cells.where(F.col(slot).between(0, n - 1) & F.col(value).isNotNull()).select(*keys, slot, *rank, value)
    spark = cells.sparkSession
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    # Rows reach the RDD as Arrow batches in one binary cell each, not as one pickled object per row.
    batches = rows.mapInArrow(pack, "payload binary").rdd
    wide = batches.flatMap(cells_of).combineByKey(create, absorb, join, numPartitions=partitions or shuffle_width(spark)).map(emit)
    return spark.createDataFrame(wide, schema, verifySchema=False)


def wide_months(readings: DataFrame, merger: str = "latest", names: Sequence[str] = CATEGORIES) -> DataFrame:
    """(mo_id, ym, one DOUBLE per category) for every MO and month with a usable reading.

    'latest' keeps the reading of the month's last day, of that the last loaded one (then the larger spend_id), so
    corrections win over what they correct and repeated rows change nothing.
    """
    cells = readings.select(
        "mo_id",
        month_index(F.col("day")).alias("month"),
        "slot",
        F.unix_date("day").alias("on_day"),
        F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62))).alias("loaded"),
        F.coalesce("spend_id", F.lit(-(2**62))).alias("id"),
        "value",
    )
    rank = ("on_day", "loaded", "id") if merger in ("latest", "earliest") else ()
    wide = widen(cells, ("mo_id", "month"), "slot", "value", [Slot(c, "double", merger) for c in names], rank)
    return wide.select("mo_id", month_of_index(F.col("month")).alias("ym"), *[F.col(f"`{c}`") for c in names])


def empty_cells(wide: DataFrame, keys: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """One row (keys, label) for every NULL cell of a wide table."""
    holes = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in names)))
    return wide.select(*keys, F.explode(holes).alias(label))
