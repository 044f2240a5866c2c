"""MinHash near-dedup by an inverted join on signature coordinates.

Documents of equal shingle sets form a class; only classes are compared. Each class is posted under
its signature's (coordinate, value) pairs. Classes whose sets overlap enough share at least
``MATCHES`` of the ``COORDINATES`` pairs, so by the prefix principle they also share one among the
rarest ``COORDINATES - MATCHES + 1`` of each; the other, longer lists are skipped. A pair of a list is
a candidate if its signatures collide often enough and its parity sketches, whose difference has at
most a bit for each element that only one set has, do not rule it out. Candidates are confirmed on
the full sets.

No list is expanded into all its pairs. First every class is compared with the heads (least ids) of
its lists, then with the heads of larger components in its lists; the best candidate of each class is
confirmed, which gathers a group of near copies. Then lists that lie within one component are
skipped, and in each of the others the members outside its largest component are joined with those
of other components, on the condition that the pair is a candidate. After that every pair of a list
is ruled out, confirmed or denied, or known to be in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.llm.common import Scratch, bitmap_of, col, released, sliced, small_batches, store, without
from veridra.llm.words import MIX, SPREAD, cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
COORDINATES = 64
#: Of 64 coordinates, a pair at similarity 0.8 shares fewer than this with probability 1e-7.
MATCHES = 33
#: Bits of each value that two signatures are compared by.
DIGEST_BITS = 8
#: Bits of a parity sketch.
PARITY_BITS = 2048
#: Members of a list that are compared in one block; longer lists are dealt out block by block.
BLOCK = 4096

Keep = Callable[[DataFrame], DataFrame]
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words, lower-cased in A-Z, or of all its
    words if it has fewer."""
    words = cut([t.lower() for t in texts])
    number, hashes = words.numbered()
    w = hashes[number]
    runs = w.copy()
    for i in range(1, n):
        runs = (runs[:-1] ^ (runs[:-1] >> np.uint64(32))) * SPREAD + w[i:] if len(runs) > 1 else runs[:0]
    runs = _last(runs, n)
    out, at = [], 0
    for count in words.counts.tolist():
        if count >= n:
            out.append(np.unique(runs[at : at + count - n + 1]))
        else:
            whole = w[at : at + min(count, 1)].copy()
            for x in w[at + 1 : at + count]:
                whole = (whole ^ (whole >> np.uint64(32))) * SPREAD + x
            out.append(_last(whole, count))
        at += count
    return out


def _last(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX + np.uint64(size)
    return h ^ (h >> np.uint64(32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES values of 32 bits for each set; the sets are not empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, product = np.empty((len(sets), COORDINATES), "<u4"), np.empty_like(every)
    for k, a in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(np.multiply(every, a, out=product), starts) >> np.uint64(32)
    return out


def parity(s: np.ndarray) -> bytes:
    """For each of PARITY_BITS buckets, whether an odd number of elements falls into it."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1).tobytes()


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set (hash of the shingle set, null if it is empty), signature, parity."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for some in sliced(batch, 1, size=1_000_000):
                sets = shingles([t or b"" for t in some.column(1).to_pylist()], n)
                full = [s for s in sets if len(s)]
                made = iter(signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "set", "signature", "parity"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set binary, signature binary, parity binary")


def _posted(classes: DataFrame) -> DataFrame:
    """class and key (coordinate and value) for each coordinate."""
    high = np.arange(COORDINATES, dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                values = np.frombuffer(b"".join(some.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), COORDINATES)), pa.array((values + high).reshape(-1))], names=["class", "key"])

    return classes.select("class", "signature").mapInArrow(run, "class long, key long")


def _lists_of(values: np.ndarray) -> pa.Array:
    """A row of values for each row."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), pa.int64()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _planes(signatures: pa.Array) -> pa.Array:
    """The low bits of a signature's values as bit planes: for each bit, a word for every 64
    coordinates, so that XOR compares 64 coordinates at once."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
    bits = np.unpackbits(values[:, :, None], axis=2, count=DIGEST_BITS, bitorder="little")  # row, coordinate, bit
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return _lists_of(np.ascontiguousarray(planes).reshape(len(values), DIGEST_BITS * COORDINATES // 8).view("<i8"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _words_of(sketches: pa.Array) -> pa.Array:
    return _lists_of(np.frombuffer(b"".join(sketches.to_pylist()), "<i8").reshape(len(sketches), PARITY_BITS // 64))


_WORDS = COORDINATES // 64


def _equal(a: Column, b: Column) -> list[Column]:
    """Words whose bits tell which coordinates of two digests are equal."""
    out = []
    for w in range(_WORDS):
        differ = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        for bit in range(1, DIGEST_BITS):
            at = F.lit(bit * _WORDS + w)
            differ = differ.bitwiseOR(F.get(a, at).bitwiseXOR(F.get(b, at)))
        out.append(F.bitwise_not(differ))
    return out


def _collisions(a: Column, b: Column) -> Column:
    """The number of coordinates that two digests have in common."""
    return sum((F.bit_count(w) for w in _equal(a, b)[1:]), F.bit_count(_equal(a, b)[0]))


def _not_ruled_out(a: Column, b: Column, n: Column, similarity: float) -> Column:
    """Whether sets of n elements together can be similar enough. Their sketches differ in no more
    bits than there are elements that only one of them has, and in fewer where these share buckets:
    by six standard deviations, the pairs that are wrongly ruled out are none in practice."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = n * ((1 - similarity) / (1 + similarity)) + 1e-6
    left = F.exp(apart * (-2.0 / PARITY_BITS))
    return bits <= F.least(apart, (1 - left) * (PARITY_BITS / 2) + F.sqrt((1 - left * left) * (PARITY_BITS / 4)) * 6)


def _candidate(x: str, y: str, matches: int, similarity: float) -> Column:
    """Whether classes of the structs x and y (class, n, planes, parity) have to be confirmed.
    Each test is cheaper than the next, and the last is rarely reached."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = (n >= m * similarity - 1e-6) & (m >= n * similarity - 1e-6)
    return sizes & (_collisions(F.col(f"{x}.planes"), F.col(f"{y}.planes")) >= matches) & _not_ruled_out(F.col(f"{x}.parity"), F.col(f"{y}.parity"), n + m, similarity)


def _lists(classes: DataFrame, matches: int, keep: Keep = store) -> DataFrame:
    """key and c: class, n (elements), planes and parity, for the lists that are not skipped."""
    posted = keep(_posted(classes))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # values that no other class has are the rarest; they come first in a prefix and join nothing
    own = posted.join(shared, "key").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    length = F.size("own") - (matches - 1)
    prefix = own.filter(length > 0).select("class", F.slice("own", 1, length).alias("prefix"))
    each = prefix.join(classes.select("class", "n", _planes("signature").alias("planes"), _words_of("parity").alias("parity")), "class")
    return keep(each.select(F.explode("prefix.key").alias("key"), F.struct("class", "n", "planes", "parity").alias("c")))


def _attached(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float, keep: Keep) -> DataFrame:
    """Of candidates x and y, the best one of each x, if the full sets confirm it."""
    n = _collisions(F.col("x.planes"), F.col("y.planes"))
    best = pairs.select(F.col("x.class").alias("a"), F.struct(n.alias("n"), (-F.col("y.class")).alias("b")).alias("to")).groupBy("a").agg(F.max("to").alias("to"))
    return keep(confirmed(keep(best.select("a", (-F.col("to.b")).alias("b"))), docs, shingle_words, similarity, keep))


def _mixed(lists: DataFrame, edges: DataFrame, keep: Keep = store) -> DataFrame:
    """The lists that hold more than one component, with each member's component, whether that is the
    list's largest, and the number of blocks that the list is dealt out to."""
    known = components(edges, keep)
    parts = keep(lists.join(known.withColumnRenamed("id", "of"), F.col("c.class") == F.col("of"), "left").select("key", "c", F.coalesce("component", "c.class").alias("component")))
    sizes = parts.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members")).filter("parts > 1").select("key", F.col("most.component").alias("largest"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    return keep(parts.join(largest, "key").select("key", "c", "component", (F.col("component") == F.col("largest")).alias("large"), "blocks"))


def _pairs(mixed: DataFrame, matches: int, similarity: float) -> DataFrame:
    """The candidates (a, b) of different components that share a list."""
    # a pair may share many lists; it is met in that of its least common key alone
    keys = mixed.groupBy(F.col("c.class").alias("of")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    held = mixed.join(keys, F.col("c.class") == F.col("of")).drop("of")
    block = F.pmod(F.xxhash64("c.class"), F.col("blocks"))
    x = held.filter("not large").select("key", block.cast("int").alias("block"), F.col("c").alias("x"), F.col("component").alias("cx"), F.col("keys").alias("kx"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    y = held.select(F.col("key").alias("k"), every, F.col("c").alias("y"), F.col("component").alias("cy"), "large", F.col("keys").alias("ky"))
    # the whole test is the join's condition, so that a pair leaves the join only as a candidate
    test = (F.col("cx") != F.col("cy")) & (F.col("large") | (F.col("x.class") > F.col("y.class"))) & _candidate("x", "y", matches, similarity)
    first = F.array_min(F.array_intersect("kx", "ky")) == F.col("key")
    return x.join(y, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")) & test & first).select(F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, similarity: float, keep: Keep = store) -> DataFrame:
    """The pairs (a, b) of classes whose full sets overlap enough. Only documents that the bounded
    filter lets through make their sets."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = bitmap_of(ids).test()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, 1, size=1_000_000):
                some = some.filter(pa.array(held(some.column(2).to_numpy())))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingles([t or b"" for t in some.column(1).to_pylist()], n)], pa.binary())], names=["id", "set"])

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = hashed.mapInArrow(run, "id long, set binary").join(ids, "id", "left_semi")
    percent = round(similarity * 100)

    @F.arrow_udf("boolean")
    def enough(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    joined = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "set_b"}), "b")
    return joined.filter(enough("set_a", "set_b")).select("a", "b").distinct()


def components(edges: DataFrame, keep: Keep = store) -> DataFrame:
    """id and component (the least id that can be reached) of every id that has an edge (a, b).

    Each round hooks every id to its least neighbour, follows these pointers twice, and goes on with
    the edges between what is left; rounds are written to the shared folder.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
        up = keep(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        for _ in range(2):
            up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        up = keep(up)
        labels = keep(labels.join(up.withColumnRenamed("u", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        a, b = (up.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b")
        edges = keep(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).filter("a <> b").distinct())
    return labels


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are lower-cased in A-Z. A text of fewer words than a shingle is one shingle; a text without
    words, or null, has none and is linked with nothing, as is a row without id. Documents are linked
    if their sets overlap by ``similarity`` or more; component_id is the least id that links reach,
    and that document is kept. Rows repeated with an id are one document. Other columns are not read.
    An empty table gives no rows. With a lower similarity, lower ``matches`` too: a pair at that
    similarity must share so many of the 64 coordinates.
    """
    small_batches(docs)
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        keep = scratch.store
        signed = keep(_signed(plain, shingle_words))
        # copies are folded before the shuffle
        classes = keep(signed.filter("set is not null and doc_id is not null").groupBy("set").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "parity")).alias("head")).select("set", F.col("head.doc_id").alias("class"), F.col("head.n_shingles").alias("n"), "head.signature", "head.parity"))
        lists = _lists(classes, matches, keep)

        heads = lists.groupBy("key").agg(F.min("c").alias("y"))
        joined = lists.withColumnRenamed("c", "x").join(heads, "key")
        first = _attached(joined.filter((F.col("x.class") != F.col("y.class")) & _candidate("x", "y", matches, similarity)), plain, shingle_words, similarity, keep)

        mixed = _mixed(lists, first, keep)
        x = mixed.filter("not large").select("key", F.col("c").alias("x"), F.col("component").alias("cx"))
        heads = mixed.groupBy(F.col("key").alias("k"), F.col("component").alias("cy")).agg(F.min("c").alias("y"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        joined = x.join(heads, (F.col("key") == F.col("k")) & (F.col("cx") != F.col("cy")) & _candidate("x", "y", matches, similarity))
        second = _attached(joined, plain, shingle_words, similarity, keep)

        pairs = _pairs(_mixed(lists, first.unionAll(second), keep), matches, similarity)
        third = confirmed(keep(pairs), plain, shingle_words, similarity, keep)
        whole = components(first.unionAll(second).unionAll(third), keep)

        of = signed.select("doc_id", "n_shingles", "set").join(classes.select("set", "class"), "set", "left").join(whole.withColumnRenamed("id", "class"), "class", "left")
        out = of.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return store(out)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, with all their columns.

    Rows without an id stay, as do texts without words; rows repeated with an id stay or go together.
    Columns may have any name and type. An empty table stays empty.
    """
    dropped = store(decisions(docs, id_col, text_col, shingle_words, similarity).filter("not kept").select("doc_id"))
    return without(docs, id_col, dropped)
