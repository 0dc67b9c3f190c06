"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns the text operators read; a null text counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id falls in fold 0 of its own making (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(-1))


def trim() -> None:
    """Gives freed memory back to the system: a Python worker lives through many tasks, and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: list[str] = []  # folders that keep() wrote


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's spark.checkpoint.dir. Where it is unset, a folder of our own in local
    mode, as in tests, and an error on a cluster, where a machine's own folder would be of no use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="leanprompt-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def keep(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back with its own schema.

    Survives lost executors, and is compressed and column-pruned, which a checkpoint() file is not. release() removes
    the folders once the results that read them are done with.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes what keep() wrote so far; DataFrames that read it cannot be run any more. Returns how many folders went."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 10_000) -> DataFrame:
    """mapInArrow with per-task state: make() runs once in a task, its result once for each batch.

    The batch function returns a dict of column name to list/array, in the order of the schema; it gets at most rows rows.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                for a in range(0, batch.num_rows, rows):
                    yield _batch(step(batch.slice(a, rows)), arrow)
                trim()

    return df.mapInArrow(run, schema)


def by_task(df: DataFrame, schema: str, make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """As by_batch, but each task yields only what finish() returns after its last batch."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = finish = None
        for batch in batches:
            if batch.num_rows:
                if step is None:
                    step, finish = make()
                step(batch)
        if finish is not None:
            yield _batch(finish(), arrow)
        trim()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int):
    """At most per_class labelled rows of each class outside the held-out fold, in hash order of their ids, and the
    training rows' counts by class. A doc_id labelled twice counts once, with its smallest label; null labels do not count.

    The id lists have at most 2 * per_class rows, which bounds both the broadcast and what is collected.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picks = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = some if picks is None else picks.unionByName(some)
    sample = docs.join(F.broadcast(picks), "doc_id").select("doc_id", "text", "y")
    return sample, (counts.get(0, 0), counts.get(1, 0))
