"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows per Arrow batch: texts may be long, so a batch must stay small in bytes.
ARROW_ROWS = 512
# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer
# than HOT_SHARE hot keys whatever the input: that bounds every broadcast of them.
HOT_SHARE = 1000
HOT_FLOOR = 500


def prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/finlex-llm/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and the
    planner knows the size of the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._finlex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_finlex_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of every partition: a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null text is an empty one."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row a key and the number of its rows in ``count``.

    Keys with over 1/HOT_SHARE of the ``total`` rows (fewer than HOT_SHARE keys, so a
    bounded broadcast) are joined in place; all others meet by a shuffle whose largest
    key holds at most that share.  Both inputs should be materialized tables.
    """
    keys = [key] if isinstance(key, str) else key
    limit = max(total // HOT_SHARE, HOT_FLOOR)
    hot = F.broadcast(lookup.filter(F.col(count) > limit))
    cold = lookup.filter(F.col(count) <= limit)
    return (rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
            .unionByName(rows.join(hot, keys)))
