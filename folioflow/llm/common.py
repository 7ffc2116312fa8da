"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.sources.tables import table

#: Kept between the tasks of one Python worker, by the token that the driver gave.
_KEPT: dict[str, Any] = {}


def token() -> str:
    """A name under which a worker may keep what it built from a broadcast."""
    return uuid.uuid4().hex


def kept(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, made once per worker; only the latest few are kept."""
    if name not in _KEPT:
        while len(_KEPT) > 11:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[name] = build()
    return _KEPT[name]


def map_columns(df: DataFrame, fn: Callable[..., dict[str, Any] | list], schema: str | StructType, setup: Callable[[], Any] | None = None) -> DataFrame:
    """``fn(columns)`` over Arrow batches; columns are Python lists, the result a dict of lists.

    With ``setup``, its result (made once per task) is the second argument.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            if setup is not None and state is None:
                state = setup()
            out = fn(columns, state) if setup is not None else fn(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


#: Tables of up to so many short rows are sent to every task, larger ones joined by a shuffle.
MAX_SENT = 1_000_000


def sent_if_small(written: DataFrame, rows: int = MAX_SENT) -> DataFrame:
    """A written table of short rows, marked to be sent to every task if it has at most so many rows."""
    return F.broadcast(written) if written.count() <= rows else written


def spoken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, text) of body and dialogue blocks whose text isn't null."""
    blocks = table(spark, sf_dir, "blocks")
    return blocks.where(F.col("type").isin("body", "dialogue") & F.col("text").isNotNull()).select("book", "block_no", "text")
