"""What the training-data operators share: reading tables, temporary tables, and caches of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, path, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of a data folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows and bytes of an Arrow batch where texts or sets go to Python and come back as large again.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"


@contextmanager
def small_batches(spark: SparkSession, reader_rows: str | None = None) -> Iterator[None]:
    """What is written inside goes to Python in batches of at most BATCH_ROWS and BATCH_BYTES; the session's settings are as before afterwards.

    With ``reader_rows``, Parquet files are read by that many rows at a time there: the JVM holds each column of them in one array.
    """
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    if reader_rows:
        own["spark.sql.parquet.columnarReaderBatchSize"] = reader_rows
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What empties the caches of each module in a Python worker, and the module whose stage ran last there.
_clearers: dict[str, Callable[[], None]] = {}
_running = [""]


def cached(owner: str, clear: Callable[[], None]) -> None:
    """Registers what empties the caches that ``owner`` keeps between tasks."""
    _clearers[owner] = clear


def begin(owner: str, anew: bool = False) -> None:
    """To be called where a task starts: if another module ran in this worker before, its caches go and free memory is given back.

    With ``anew`` the owner's own caches go as well, whatever ran before.
    """
    if _running[0] == owner and not anew:
        return
    for other, clear in _clearers.items():
        if other != owner or anew:
            clear()
    if _running[0]:
        gc.collect()
        give_back()
    _running[0] = owner


def give_back() -> None:
    """Gives memory that is free in this process, but was kept for later, back to the machine; caches stay."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """The column with exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")
