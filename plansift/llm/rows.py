"""Arrow transfer for operators that work row by row in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from plansift.session import settle, small

#: Rows of a batch that are Python objects at a time.
AT_ONCE = 1024


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of any table: null texts are empty, other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def text_or_empty(text_col: str | Column) -> Column:
    return F.coalesce((F.col(text_col) if isinstance(text_col, str) else text_col).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it (in any case)."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def mark_of(text_col: str | Column) -> Column:
    """A hash that tells texts apart; null counts as empty."""
    return F.xxhash64(text_or_empty(text_col), F.lit(11))


def only_kept(docs: DataFrame, verdict: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """``docs`` without the rows that a verdict drops, all columns as they were.

    ``verdict`` has ``doc_id, mark, kept`` for every row, at most one of those
    alike in id and mark kept. What goes is named by both and sent to all tasks
    if it is little, so that texts need not travel, and joined otherwise. Rows
    alike in both are told apart by a further step that sees such rows alone.
    """
    id_, own = unused(docs, "__id", "__mark")
    keys = verdict.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    keys = settle(keys.filter("n > 1 or not kept").select(F.col("doc_id").alias(id_), F.col("mark").alias(own), "kept"), "keys")
    gone, again = keys.filter("not kept").drop("kept"), keys.filter("kept").drop("kept")
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), own: mark})

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(small(right), left[id_].eqNullSafe(right[id_]) & (left[own] == right[own]), how)

    kept = meet(keyed, gone, "left_anti")
    if not again.isEmpty():
        kept = meet(kept, again, "left_anti").unionByName(meet(kept, again, "left_semi").dropDuplicates([id_, own]))
    return kept.drop(id_, own)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Map batches of columns, as Python lists, to batches of columns.

    ``make`` runs once per task and returns the function of a batch, so tables
    that are costly to build are built once. Batches stream, and a batch is
    turned into Python objects ``AT_ONCE`` rows at a time.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                out = work(*(column.to_pylist() for column in batch.slice(at, AT_ONCE).columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)
