"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from lakemart.session import scratch_path


def by_value(name: str) -> None:
    """Let the functions of a module travel to the executors with the task.

    Executors then need Python and the libraries, but not this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker (a loaded vocabulary, a cache)."""
    store = vars(sys).setdefault("_lakemart_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def fresh(df: DataFrame, label: str, *others: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of their names."""
    taken = {c.lower() for frame in (df, *others) for c in frame.columns}
    name, n = f"_{label}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{label}{n}"
    return name


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DOCUMENTS_AT_ONCE = 1_000


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of at most 1,000 rows: documents have kilobytes, not bytes.

    Spark's 10,000 rows are tens of megabytes of text, held several times over by a task
    and its Python worker. The setting stays with the session; a smaller one is kept.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= DOCUMENTS_AT_ONCE:
        spark.conf.set(ARROW_ROWS, str(DOCUMENTS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame below the shared checkpoint folder and read it back.

    Cuts the lineage: later steps read files that outlive a lost executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Give free memory back to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy_after(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that gives back memory when its task ends."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        tidy()

    return tidied


BYTES_AT_ONCE = 4 << 20


def slices_of(batch: pa.RecordBatch, by: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about :data:`BYTES_AT_ONCE` bytes in column ``by``, a row at least."""
    size, begin = 0, 0
    for i, value in enumerate(batch.column(by)):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= BYTES_AT_ONCE or i == batch.num_rows - 1:
            yield batch.slice(begin, i + 1 - begin)
            size, begin = 0, i + 1


def with_computed(
    df: DataFrame, source: str, alias: str, kind: pa.DataType, make: Callable[[], Callable[[Any], Any]]
) -> DataFrame:
    """Add a column computed in Python from a string or binary one, a few megabytes at a time.

    ``make`` is called once per task and gives the function of a value. Unlike a
    function in an expression, this is one step that Spark neither repeats nor merges
    with the next. A column named like ``alias`` is replaced.
    """
    kept = [c for c in df.columns if c != alias]
    wide = df.withColumn(fresh(df, "source"), col(source)).select(fresh(df, "source"), *[col(c) for c in kept])
    fields = [f for f in df.schema.fields if f.name != alias]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices_of(batch, 0):
                found = pa.array([compute(v.as_py()) for v in part.column(0)], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], found], names=[*kept, alias])

    return wide.mapInArrow(tidy_after(run), T.StructType([*fields, T.StructField(alias, from_arrow_type(kind))]))
