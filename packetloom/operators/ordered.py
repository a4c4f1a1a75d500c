"""State machines over the ordered rows of each key, in bounded memory.

Rows are partitioned by key and sorted within partitions, which spills where it must.
One pass of Arrow batches then hands each key's rows to a function in order; a key's
rows are never gathered, so one that holds a third of all rows costs time, not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.scratch import stage


def ordered_map(df: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, Iterator[dict]], Iterable[tuple]], schema: str | T.StructType, placed: bool = False) -> DataFrame:
    """``run(key, rows)`` for each key; what it yields becomes rows of ``schema``.

    ``placed``: each key's rows already lie together and in order, as behind a window over it.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    rows_of = df if placed else df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)

    key_of = itemgetter(*keys) if len(keys) > 1 else lambda row: (row[keys[0]],)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in _dicts(batch))
        current = next(rows, None)
        out: list[tuple] = []
        size = 0

        def group(key: tuple) -> Iterator[dict]:
            nonlocal current
            while current is not None and key_of(current) == key:
                row, current = current, next(rows, None)
                yield row

        while current is not None:
            key = key_of(current)
            mine = group(key)
            for made in run(key, mine):
                out.append(made)
                size += 200 + sum(len(x) for x in made if isinstance(x, bytes | str))
                if size > 4 << 20:
                    yield _batch(out, arrow)
                    out, size = [], 0
            for _ in mine:  # a function may stop before its key's end
                pass
        if out:
            yield _batch(out, arrow)

    return rows_of.mapInArrow(work, fields)


def _values(column: pa.Array) -> list:
    """A column's Python values, as ``to_pylist`` gives them but without a scalar object for each where the type allows it."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, values)) for values in zip(*map(_values, batch.columns)))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def numbered(df: DataFrame, order: Column, value: Column, count: str, highest: str, width: int = 65_536) -> DataFrame:
    """``df`` with the running number of rows (from 1) and the running maximum of ``value``, over all rows by ``order`` (a long).

    Not one window over everything, which would be one task: a window within blocks of
    ``width`` order values, and the totals of the blocks before, which a window over the
    table of blocks gives. That table has two numbers for each block and is written, so
    ``df`` is read once for the blocks and once for its rows.
    """
    df = df.withColumn("_o", order).withColumn("_b", F.floor(order / width)).withColumn("_v", value)
    blocks = df.groupBy("_b").agg(F.count("*").alias("_n"), F.max("_v").alias("_m")).withColumn("_c", F.floor(F.col("_b") / width))
    blocks = stage(blocks, "blocks")
    # Blocks of blocks: only the last window, with a row for some four billion order values, is one task.
    upper = blocks.groupBy("_c").agg(F.sum("_n").alias("_un"), F.max("_m").alias("_um"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("_c", F.sum("_un").over(before).alias("_un"), F.max("_um").over(before).alias("_um"))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_c", "_b", F.sum("_n").over(before).alias("_n"), F.max("_m").over(before).alias("_m")).join(upper, "_c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    blocks = blocks.select("_b", (zero("_n") + zero("_un")).alias("_n"), F.greatest("_m", "_um").alias("_m"))
    within = Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_k": F.count("*").over(within), "_x": F.max("_v").over(within)}).join(blocks, "_b")
    return df.withColumns({count: F.col("_k") + F.col("_n"), highest: F.greatest("_x", "_m")}).drop("_o", "_b", "_v", "_k", "_x", "_n", "_m")
