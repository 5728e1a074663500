"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
#: Takes batches of texts and gives a result for each text.
TextResult = Callable[[Iterator[pa.Array]], Iterator[pa.Array]]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; a local session without it gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if folder is None and context.getCheckpointDir() is not None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="claimlab-")
        context.setCheckpointDir(folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read from there: short lineage that outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: dict = {}


def kept_in_worker(key, build):
    """What a Python worker keeps from task to task. It keeps one thing at a time, so an operator that runs in a
    worker after another one doesn't find the other's memory still taken."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def keep_nothing() -> None:
    """Called by tasks that keep no cache, when they begin and when they end."""
    _kept.clear()
    give_back()


def give_back() -> None:
    """Called at the end of tasks, so that workers that wait for the next one hold little memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it if the table has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_text_result(df: DataFrame, kind: str, compute: TextResult) -> tuple[DataFrame, str, list[Column]]:
    """The table with a column computed from `text`, that column's name, and the columns that give the table back.

    Whole batches of rows stream through the worker, so the JVM holds no queue of rows that wait for a result.
    """
    name = free_name(df, "result")
    place = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                waiting.append(batch)
                yield batch.column(place)

        for result in compute(texts()):
            batch = waiting.popleft()
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, name])

    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema]
    schema = T.StructType([*fields, T.StructField(name, T.DataType.fromDDL(kind), True)])
    return df.mapInArrow(run, schema), name, [F.col(f"`{c}`") for c in df.columns]


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of documents whose labels are never learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts don't add up in workers and in the JVM's buffers.

    The registered queries and the pipeline set this on their session; the operators leave it alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return public_tokenizers.path(name)
