"""What the operators share: tables in the shared folder, bounded slices of Arrow batches, and byte-level text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts, ``[\x20\x09-\x0D]``; also what ``bytes.split()`` splits on.
BLANKS = b" \t\n\x0b\x0c\r"

#: Texts that a Python worker takes at a time from an Arrow batch, whose bytes Spark bounds.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a temporary folder serves a local master, whose tasks all run on this machine; on a cluster
    other machines would never see it, so there the setting is asked for. The folder goes when the application ends.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local.get(context.applicationId) or _local.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tracery-"))
    own = f"{found.rstrip('/')}/{context.applicationId}"
    if own not in _leaving:
        _leaving.add(own)
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


#: Folders that go when the application ends; temporary folders by application.
_leaving: set[str] = set()
_local: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a table in the shared folder and read it again.

    The table outlives lost executors. ``discard`` removes it when nothing reads it any more, the end of the
    application what is left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that no result still to be computed reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, without a copy; bounds what a worker makes of texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Filter:
    """A Bloom filter of 64-bit keys: False for a key means that it is not among them.

    16 bits a key, up to WORDS words; beyond that more keys pass that are none, which costs work, never rows. The bits
    are gathered by word, so at most WORDS rows come to the driver, however many keys there are.
    """

    WORDS = 1 << 21
    PROBES = 4

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Filter:
        n = keys.count()
        size = 1 << min(cls.WORDS.bit_length() - 1, max(4, (n // 4).bit_length()))
        low, high = F.col(key).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(key), 32).bitwiseOR(F.lit(1))
        at = F.explode(F.array(*[(low + high * k).bitwiseAND(size * 64 - 1) for k in range(cls.PROBES)]))
        places = keys.select(at.alias("at"))
        bits = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
        words = np.zeros(size, dtype=np.uint64)
        words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Of int64 keys, those that may be held."""
        k = keys.astype(np.int64, copy=False).view(np.uint64)
        low, high = k & np.uint64(0xFFFFFFFF), (k >> np.uint64(32)) | np.uint64(1)
        found = np.ones(len(k), dtype=bool)
        for turn in range(self.PROBES):
            at = (low + high * np.uint64(turn)) & np.uint64(len(self.words) * 64 - 1)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def column(self, spark: SparkSession, key: Column) -> Column:
        """``passes`` as a column; only the keys go to Python."""
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def passes(keys: pd.Series) -> pd.Series:
            return pd.Series(held.value.passes(keys.to_numpy(dtype=np.int64)))

        return passes(key)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text, null texts as empty ones; null ids are apart from all others."""
    body = F.coalesce(text, F.lit(""))
    return F.xxhash64(doc_id.isNull(), doc_id, body), F.xxhash64(body, F.lit(7), doc_id)


def without(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are not in ``gone``; of those that share a key in ``again``, one.

    gone and again: (row_a, row_b) as ``row_key`` has them, written tables without repeated rows. A filter lets through
    the rows that may be among them, and only these are joined, so the others' texts are not shuffled. Columns of
    ``docs`` may have any names.
    """
    spark, names = docs.sparkSession, [f"c{k}" for k in range(len(docs.columns))]
    a, b = row_key(docs["doc_id"], docs["text"])
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], a.alias("row_a"), b.alias("row_b"))
    named = gone.withColumn("stays", F.lit(False))
    repeats = bool(again.limit(1).count())
    if repeats:
        named = named.unionByName(again.withColumn("stays", F.lit(True)))
    met = Filter.of(named, "row_a").column(spark, F.col("row_a"))
    out = rows.where(~met).select(*names)
    held = rows.where(met).join(named, ["row_a", "row_b"], "left")
    out = out.unionByName(held.where("stays is null").select(*names))
    if repeats:
        out = out.unionByName(held.where("stays").dropDuplicates(["row_a", "row_b"]).select(*names))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def shipped(spark: SparkSession, path: str) -> str:
    """Send a small file of the driver's to all executors; ``on_executor`` finds it there."""
    spark.sparkContext.addFile(path)
    return path


def on_executor(path: str) -> str:
    """Where a task reads a shipped file: at its own path on the driver's machine, else in Spark's folder of files."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts empty; every other column, whatever its name, is dropped here."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return pc.cast(column, pa.binary()).to_pylist()


def map_texts(docs: DataFrame, each: Callable[[list[bytes]], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A batch-wise function of the texts as UTF-8: ``each`` gets a list of bytes and returns the new columns.

    ``schema`` lists the new columns; the columns in ``keep`` pass through.
    """
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    fields = [x.strip().rsplit(" ", 1)[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = each(utf8(batch.column(batch.schema.get_field_index("text"))))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + [made[f] if isinstance(made[f], pa.Array) else pa.array(made[f]) for f in fields], names=[*keep, *fields])

    return docs.mapInArrow(run, f"{kept}, {schema}")


def training_fold(id_column: str, modulus: int):
    """crc32(doc_id as text) mod ``modulus``, as a column; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus
