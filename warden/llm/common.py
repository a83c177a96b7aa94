"""What the operators share: text batches, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CHUNK = 2 << 20  # bytes of text that a task holds as Python objects at a time


_holder = None


def take_memory(holder) -> None:
    """Lets ``holder`` (or nobody) be the one in this worker that keeps what it has learned from words.

    Spark uses a worker again for other operators; the one before forgets.
    """
    global _holder
    if _holder is not None and _holder is not holder:
        _holder.forget()
    _holder = holder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent (a local session, as in tests) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="warden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what comes after is not lost with an executor and computes nothing twice.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns alone, as bigint and string, null text as empty; other columns cannot clash."""
    return df.select(
        df[id_column].cast("bigint").alias("doc_id"),
        F.coalesce(df[text_column].cast("string"), F.lit("")).alias("text"),
    )


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = TEXT_CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``size`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


SALTS = 16  # parts in which the rows of a hot key meet what is known of it
HOT_ROWS = 1024  # rows from which a key is hot


def met_by_key(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of ``rows`` with ``known``, which has one row a key and, in ``count``, the rows that each key will meet.

    Rows of a hot key meet a copy of its row in ``SALTS`` parts. They then go on under a key of their own, which is odd;
    keys are even, so that they meet nothing twice and no task has more of them than its share. Null keys meet nothing and
    are spread likewise. Rows are spread by a hash of all their columns, so that a lost task repeats what it did; rows
    equal in all of them stay together. Other columns of ``known`` must not be named like those of ``rows``.
    """
    others = [c for c in known.columns if c not in (key, count)]
    hot = known.filter(F.col(count) > HOT_ROWS).select(
        F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"), F.lit(True).alias("__hot"),
        *[F.col(c).alias(f"__{c}") for c in others],
    )
    own = F.xxhash64(*rows.columns)
    salted = rows.withColumn("__own", own).withColumn("__salt", F.pmod(F.col("__own"), F.lit(SALTS)).cast("int"))
    met = salted.withColumnRenamed(key, "__key").join(hot, ["__key", "__salt"], "left")
    alone = F.col("__hot").isNotNull() | F.col("__key").isNull()
    met = met.withColumn("__rest", F.when(alone, F.col("__own").bitwiseOR(F.lit(1))).otherwise(F.col("__key")))
    cold = known.filter(F.col(count) <= HOT_ROWS).drop(count).withColumnRenamed(key, "__rest")
    return met.join(cold, "__rest", "left").select(
        *[F.col("__key").alias(key) if c == key else F.col(c) for c in rows.columns],
        *[F.coalesce(f"__{c}", c).alias(c) for c in others],
    )


def keep_rows(df: DataFrame, decide: Callable[[], Callable[[list[str]], list[bool]]], text_column: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose texts ``decide()`` keeps; it is called once in each task.

    Null text is passed as empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = decide()
        for batch in chunks(batches, text_column):
            yield batch.filter(pa.array(keep([t or "" for t in batch.column(text_column).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
