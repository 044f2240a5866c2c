"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.plans.shared import Scratch, store

#: Bytes 0x20 and 0x09 to 0x0D separate words; this is also what ``bytes.split()`` does.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Bytes of a batch that is sent to a Python worker, unless one row has more. Rows hold whole texts, so
#: Spark's own bound (64 MB, or 10,000 rows) would have each worker, and the executor too, hold far more
#: than it works on.
BATCH_BYTES = 4_000_000

#: Bits of a bounded filter, at most: 16 MB. Few rows need fewer, so many for each.
FILTER_BITS = 1 << 27
BITS_PER_ROW = 64


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with any of ``df`` (case is ignored, as Spark does)."""
    used = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in used:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of this name, whatever characters (dots too) it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def small_batches(df: DataFrame) -> None:
    """Bounds the batches that the session sends to Python workers, unless the user has set a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, "67108864b") in ("67108864b", "67108864", "64MB", "64m"):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each 64-bit hash: equal ranges of its high half."""
    return ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each 64-bit hash in its owner's bitmap, by its low half."""
    return (((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)


class Bitmap:
    """A set of 64-bit hashes as owners' bitmaps one after another: of a fixed size whatever their
    number, so that it can be broadcast. It may hold hashes that were not put in, never the reverse."""

    def __init__(self, spark: SparkSession, bits: int):
        self.owners = partitions(spark)
        self.slots = max(8, bits // self.owners // 8 * 8)

    def gathered(self, spark: SparkSession, parts: DataFrame) -> Bitmap:
        """parts: owner and bits, the compressed bitmap of each."""
        size = self.slots // 8
        whole = np.zeros(self.owners * size, np.uint8)
        for owner, bits in parts.toLocalIterator():
            whole[owner * size : (owner + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(bits)), np.uint8)
        self.sent = spark.sparkContext.broadcast(whole.tobytes())
        return self

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function for workers: which hashes (64-bit, signed) may be in the set."""
        sent, owners, slots = self.sent, self.owners, self.slots

        def held(h: np.ndarray) -> np.ndarray:
            u = np.ascontiguousarray(h).view(np.uint64)
            at = owner_of(u, owners).astype(np.int64) * slots + slot_of(u, slots)
            return (np.frombuffer(sent.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        return held

    def column(self, h: Column) -> Column:
        """Whether the hash may be in the set."""
        test = self.test()

        @F.arrow_udf("boolean")
        def held(h: pa.Array) -> pa.Array:
            return pa.array(test(h.to_numpy(zero_copy_only=False)))

        return held(h)


def bits_for(df: DataFrame, most: int) -> int:
    """Bits of a filter for the rows of ``df``."""
    return min(most, max(1 << 16, BITS_PER_ROW * df.count()))


def packed_bits(h: np.ndarray, slots: int) -> bytes:
    bits = np.zeros(slots, bool)
    bits[slot_of(h, slots)] = True
    return zstandard.ZstdCompressor().compress(np.packbits(bits).tobytes())


def bitmap_of(ids: DataFrame, bits: int = FILTER_BITS) -> Bitmap:
    """The hashes (xxhash64) of the one column of ``ids``."""
    spark = ids.sparkSession
    made = Bitmap(spark, bits_for(ids, bits))
    owners, slots = made.owners, made.slots

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            own = owner_of(h, owners).astype(np.int64)
            at = np.flatnonzero(np.diff(own, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array([x.tobytes() for x in np.split(h, at[1:])] if len(h) else [], pa.binary())], names=["owner", "hashes"])

    def answer(key, parts):
        h = np.frombuffer(b"".join(parts.column("hashes").to_pylist()), np.uint64)
        return pa.table({"owner": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed_bits(h, slots)], pa.binary())})

    hashes = ids.select(F.xxhash64(col(ids.columns[0])).alias("h")).mapInArrow(send, "owner int, hashes binary")
    return made.gathered(spark, hashes.groupBy("owner").applyInArrow(answer, "owner int, bits binary"))


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is not in the one column of ``ids``; only rows that the bounded
    filter can't clear are shuffled."""
    held = bitmap_of(ids).column(F.xxhash64(col(key)))
    mark, name = fresh(df, "held"), fresh(df, "key")
    marked = df.withColumn(mark, held)
    rest = marked.filter(F.col(mark)).withColumn(name, col(key)).join(ids.toDF(name).distinct(), name, "left_anti")
    return marked.filter(~F.col(mark)).select(columns(df)).unionByName(rest.select(columns(df)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and of so many bytes in column ``text`` unless one
    row has more, so that a few very long texts are not in memory together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (held + n > size or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def trimmed() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task keeps little."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving back its memory at the end of a task: workers outlive tasks,
    and those of one operator would otherwise hold theirs while the next one runs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return whole
