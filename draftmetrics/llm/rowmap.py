"""Run a vectorised Python function over one text column and keep every other column as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmetrics.llm.shared import text_slices, tidied


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores if a column (in any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_text_struct(docs: DataFrame, text_col: str, name: str, ddl: str, make: Callable[[], Callable[[list[str | None]], list[list]]], slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with a struct column ``name``, made from whole texts.

    ``make()`` is called once for each task and gives a function from texts to one list of
    values for each field of ``ddl``.  Texts reach it in slices of ``slice_bytes`` (a longer
    text is a slice of its own).
    """
    struct = T.StructType.fromDDL(ddl)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, struct)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in struct.fields]
        work = None
        for batch in batches:
            work = work or make()
            for a, b, texts in text_slices(batch.column(at), slice_bytes):
                values = [pa.array(v, k) for v, k in zip(work(texts), kinds)]
                made = pa.StructArray.from_arrays(values, names=[f.name for f in struct.fields])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    if dict(docs.dtypes)[text_col] != "string":
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
        schema = T.StructType([*docs.schema.fields, T.StructField(name, struct)])
    return docs.mapInArrow(tidied(run), schema)
