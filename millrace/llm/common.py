"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space that ends a word in the contracts' word pattern.
WORD = r"[^\x20\x09-\x0D]+"


def give_back_freed() -> None:
    """What this process frees goes back to the system at once.

    A Python worker outlives its tasks. By default the allocator keeps up to
    64 MB of what one task freed, and Arrow's own pool keeps its batches, in each
    of an executor's workers, beside the JVM.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc
        return
    for option in (-3, -1):  # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD: fixed, so they no longer grow
        mallopt(option, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


if getattr(getattr(sys.modules["__main__"], "__spec__", None), "name", "") == "pyspark.daemon":  # in a worker only
    give_back_freed()

#: Rows of an Arrow batch, where the session leaves Spark's default of 10,000: texts of some KB then take MB, not tens of MB, on both sides of a worker's pipe.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session if set; else the context's own
    checkpoint folder; else, on a single machine only, a temporary folder.
    """
    sc = spark.sparkContext
    asked = spark.conf.get("spark.checkpoint.dir", None)
    if asked:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(asked)
        return asked.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: the rows are written to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut`` for larger tables: compressed Parquet in the shared folder, read back with column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, k: int):
    """crc32 of the id's decimal text, modulo k; a null id counts as the text 'null'."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % k).cast("int")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about ``most`` bytes of text, a single longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            yield batch.slice(at, to - at)


def map_texts(df: DataFrame, start: Callable[[], Callable[[list], list[pa.Array | list]]], schema: str, most: int = 4_000_000) -> DataFrame:
    """Applies a function to the column ``text``, ``most`` bytes at a time; all other columns pass through untouched.

    ``start`` runs once a task and returns the function: a list of texts (None
    for null) to a list of new columns as ``schema`` names them. Ids stay Arrow
    columns, so nulls and large values survive.
    """
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != "text"]
    out = T.StructType(kept + T._parse_datatype_string(schema).fields)
    names = [f.name for f in kept]
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in slices(batches, most=most):
            new = fn(batch.column("text").to_pylist())
            cols = [batch.column(n) for n in names] + [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, arrow.field(len(names) + i).type) for i, c in enumerate(new)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def keep_texts(df: DataFrame, start: Callable[[], Callable[[str | None], bool]], text_col: str = "text") -> DataFrame:
    """The rows whose text passes, all columns untouched, a few MB of text at a time. ``start`` runs once a task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([bool(keep(t)) for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_texts(df: DataFrame, start: Callable[[], Callable[[str], str]], text_col: str = "text") -> DataFrame:
    """``df`` with its texts rewritten, a few MB at a time; nulls and all other columns stay. ``start`` runs once a task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            new = pa.array([t if t is None else change(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


#: Numbers of a vector that travel in one row.
CHUNK = 1 << 14
#: Rows of a chunk that a task adds up at the first level: those of so many neighbouring map tasks.
NEIGHBOURS = 512


def summed_vector(parts: DataFrame, key: str, length: int, dtype: str, combine=np.add, finish: Callable[[np.ndarray], np.ndarray] | None = None, finished: str | None = None) -> dict[int, np.ndarray]:
    """Adds up equally long vectors, one total per key, by chunks so that no task holds them all.

    ``parts`` has (key int, chunk int, data binary) as ``chunked`` makes them.
    Chunks are added in two levels, first those of ``NEIGHBOURS`` map tasks, so
    a group stays bounded however many tasks there are. ``finish`` maps each
    total on the executors, to numbers of the type ``finished``. The result is ``length`` numbers a key: bounded by
    the caller's fixed length and number of keys, whatever the corpus.
    """
    schema = "key int, chunk int, data binary"

    def total(pdf: pd.DataFrame) -> np.ndarray:
        out = unpacked_numbers(pdf["data"].iloc[0]).astype(dtype)
        for b in pdf["data"].iloc[1:]:
            combine(out, unpacked_numbers(b).astype(dtype), out=out)
        return out

    def row(pdf: pd.DataFrame, numbers: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "data": [packed_numbers(numbers)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return row(pdf, total(pdf))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        return row(pdf, finish(total(pdf)) if finish else total(pdf))

    near = parts.withColumn("near", (F.spark_partition_id() / NEIGHBOURS).cast("int")).groupBy("key", "chunk", "near").applyInPandas(add, schema)
    out: dict[int, np.ndarray] = {}
    for r in near.groupBy("key", "chunk").applyInPandas(end, schema).collect():
        piece = unpacked_numbers(r["data"])
        whole = out.setdefault(r["key"], np.zeros(length, dtype=finished or dtype))
        at = r["chunk"] * CHUNK
        whole[at : at + len(piece)] = piece
    return out


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, compressed; floats as they are."""
    if numbers.dtype.kind in "iu":
        most = int(numbers.max(initial=0))
        numbers = numbers.astype(next((t for t in ("u1", "u2", "u4") if most < 1 << 8 * int(t[1])), "i8"))
    return numbers.dtype.str[1:].encode() + packed(numbers.tobytes())


def unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(unpacked(data[2:]), data[:2].decode())


def chunked(key: int, vector: np.ndarray) -> pd.DataFrame:
    """Rows for ``summed_vector``; chunks that hold only zeros are left out."""
    rows = [(key, i // CHUNK, packed_numbers(vector[i : i + CHUNK])) for i in range(0, len(vector), CHUNK) if vector[i : i + CHUNK].any()]
    return pd.DataFrame(rows, columns=["key", "chunk", "data"]).astype({"key": "int32", "chunk": "int32"})


#: A table up to this size is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, row_bytes) -> DataFrame:
    """``df`` (already written by ``cut`` or ``staged``) marked for broadcast if its measured size allows.

    ``row_bytes`` is a column expression with a row's bytes.
    """
    size = df.agg(F.sum(row_bytes).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def without(docs: DataFrame, gone: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """``docs`` without the rows whose id and ``mark`` (a hash of the text) are in ``gone`` (two columns); rows with a null id stay.

    The mark tells rows apart that repeat an id with another text. ``gone`` is
    written once; it is broadcast only while its measured size allows, else both
    sides shuffle by id.
    """
    ids = cut(gone.toDF("__gone", "__mark").filter("__gone is not null").distinct())
    return docs.join(broadcast_if_small(ids, F.lit(16) + F.length(F.col("__mark").cast("string"))), (docs[id_col].cast("long") == F.col("__gone")) & mark.eqNullSafe(F.col("__mark")), "left_anti")
