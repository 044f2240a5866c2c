"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every task turns its texts into 64-bit fingerprints, sorts the distinct ones, and sends each owner
   (an equal range of the fingerprint space) one Golomb-Rice coded message. A fingerprint that a
   task holds twice is sent once, with a mark; a group that fills a third of the table therefore
   costs its owner one entry for each task.
2. An owner merges its messages and answers with a bitmap over the slots of its range: a set slot
   holds a fingerprint that occurs more than once. All bitmaps together have ``bitmap_bits`` bits,
   whatever the size of the table, so they can be broadcast. Slots may be shared; that only makes
   more suspects.
3. Rows in a set slot are suspects. Only they travel with their text, and are grouped by the text
   itself, after a map-side aggregation that leaves one row for each text and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import FILTER_BITS, Bitmap, bits_for, col, columns, fresh, owner_of, packed_bits, store

#: A group of copies is broadcast if it holds more than one in so many of the rows that have copies.
HOT_SHARE = 10_000


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of unsigned gaps: the parameter, the unary quotients, the remainders."""
    mean = max(1.0, float(gaps.astype(np.float64).mean()))
    k = max(0, int(np.floor(np.log2(mean * 0.6931471805599453 + 1))))
    q = (gaps >> np.uint64(k)).astype(np.int64) if k < 64 else np.zeros(len(gaps), np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = np.zeros((len(gaps), k), np.uint8)
    for b in range(k):
        rest[:, b] = (gaps >> np.uint64(k - 1 - b)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(k: int, unary: bytes, rest: bytes, n: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
    out = np.zeros(n, np.uint64)
    for b in range(k):
        out = (out << np.uint64(1)) | bits[:, b].astype(np.uint64)
    return out + (q.astype(np.uint64) << np.uint64(k))


def _fingerprint(text) -> F.Column:
    return F.xxhash64(text)


def duplicates(docs: DataFrame, text_col: str, bitmap_bits: int = FILTER_BITS) -> Bitmap:
    """The owners' bitmaps of the fingerprints that occur more than once."""
    spark = docs.sparkSession
    made = Bitmap(spark, bits_for(docs, bitmap_bits))
    owners, slots = made.owners, made.slots

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        own = owner_of(h, owners)
        cuts = np.flatnonzero(np.diff(own)) + 1
        rows = []
        for at, end in zip([0, *cuts], [*cuts, len(h)], strict=True):
            k, unary, rest = golomb_encode(np.diff(h[at:end], prepend=h[at]))
            rows.append((int(own[at]), end - at, int(h[at].view(np.int64)), k, unary, rest, np.packbits(n[at:end] > 1).tobytes()))
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["owner", "n", "first", "k", "unary", "rest", "twice"])

    def answer(key, messages):
        every, own_twice = [], []
        for m in messages.to_pylist():
            h = golomb_decode(m["k"], m["unary"], m["rest"], m["n"])
            h[0] = np.int64(m["first"]).view(np.uint64)
            every.append(h := np.cumsum(h, dtype=np.uint64))
            own_twice.append(h[np.unpackbits(np.frombuffer(m["twice"], np.uint8))[: m["n"]] > 0])
        found, n = np.unique(np.concatenate(every), return_counts=True)
        twice = np.concatenate([found[n > 1], *own_twice])
        return pa.table({"owner": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed_bits(twice, slots)], pa.binary())})

    sent = docs.select(_fingerprint(F.col(text_col)).alias("h")).mapInArrow(send, "owner int, n long, first long, k int, unary binary, rest binary, twice binary")
    return made.gathered(spark, sent.groupBy("owner").applyInArrow(answer, "owner int, bits binary"))


def _marked(docs: DataFrame, text_col: str, bitmap_bits: int) -> tuple[DataFrame, str, str]:
    """``docs`` with its fingerprint and whether it is a suspect. Null texts are empty."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    held = duplicates(docs.select(text.alias("t")), "t", bitmap_bits)
    h, s = (fresh(docs, x) for x in ("fingerprint", "suspect"))
    return docs.withColumn(h, _fingerprint(text)).withColumn(s, held.column(F.col(h))), h, s


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when their bytes are; null counts as empty. The row with the largest id stays.
    Rows repeated with id and text are one document: each is returned, with the same verdict. A null
    id is smaller than any other. Other columns are not read. An empty table gives no rows.

    Rows that are no suspects are not shuffled. Of the suspects' groups, those with more than one in
    ``HOT_SHARE`` of all grouped rows are fewer than that, so they are broadcast; what is left to the
    join has no large group.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    marked, h, s = _marked(plain, "text", bitmap_bits)
    rows = marked.select("doc_id", F.col(h).alias("h"), F.sha2(F.col("text"), 256).alias("text_sha256"), F.col(s).alias("suspect"), "text")
    groups = store(
        rows.filter("suspect").groupBy("h", "text_sha256", "text").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        # of texts that the bytes tell apart, no two may share both hashes, by which rows find their group
        .groupBy("h", "text_sha256").agg(F.max("last").alias("last"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .select("h", "text_sha256", "last", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long")).alias("n"))
        .filter("n > 1")
    )
    grouped = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > grouped / HOT_SHARE
    large = groups.filter(hot).withColumnsRenamed({"last": "hot_last", "n": "hot_n"})
    found = rows.filter("suspect").drop("text", "suspect").join(F.broadcast(large), ["h", "text_sha256"], "left")
    # rows that have their group keep it; they are dealt out by their id, to a key that no group has
    dealt = F.when(F.col("hot_n").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    suspects = found.withColumn("key", dealt).join(groups.filter(~hot).select(F.col("h").alias("k"), F.col("text_sha256").alias("key"), "last", "n"), "key", "left")
    alone = rows.filter(~F.col("suspect")).select("doc_id", F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("n"), "text_sha256")
    both = alone.unionByName(suspects.select("doc_id", F.coalesce("hot_last", "last").alias("last"), F.coalesce("hot_n", "n").alias("n"), "text_sha256"))
    return both.select(
        "doc_id",
        F.when(F.col("n").isNotNull(), F.col("last")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("last").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of any name and type; see ``decisions``.

    Of rows repeated with id and text one stays, that whose other columns are the largest as JSON.
    Rows that are no suspects pass through without a shuffle.
    """
    marked, h, s = _marked(docs, text_col, bitmap_bits)
    text, last = fresh(marked, "text"), fresh(marked, "last")
    alone = marked.filter(~F.col(s)).select(columns(docs))
    others = [c for c in docs.columns if c != text_col]
    # other columns by number, as names may hold anything
    fields = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("end"))
    rank = F.struct(col(id_col).alias("id"), col(text_col).isNull().alias("null"), F.to_json(fields).alias("others"))
    kept = marked.filter(F.col(s)).withColumn(text, F.coalesce(col(text_col).cast("string"), F.lit(""))).groupBy(h, text).agg(F.max_by(F.struct(col(text_col).isNull().alias("null"), fields.alias("others")), rank).alias(last))
    at = {c: i for i, c in enumerate(others)}
    out = [F.when(F.col(f"{last}.null"), F.lit(None)).otherwise(F.col(text)).alias(c) if c == text_col else F.col(f"{last}.others.c{at[c]}").alias(c) for c in docs.columns]
    return alone.unionByName(kept.select(out))
