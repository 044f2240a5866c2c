"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the run of ``MINIMISER_WORDS`` words in it with
the least hash (the leftmost of equal ones), so it depends on nothing but the window's words, and
neighbouring windows mostly share it. Consecutive windows that share one travel together, as one
packed string, to the minimiser's bucket. A bucket therefore holds every occurrence of each of its
windows; it sorts them and finds those whose words also start earlier.

A task sends each distinct string once, from its earliest place; it already knows the later places
as repeats. A passage that a third of all documents share thus costs its bucket a string for each
few thousand documents. Minimisers are six words long, so that in ordinary prose none is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.llm.common import Scratch, bitmap_of, col, columns, fresh, released, sliced, small_batches, store, trimmed
from veridra.llm.words import MIX as _MIX
from veridra.llm.words import Words, cut
from veridra.llm.words import mixed as _mixed

WINDOW_WORDS = 20
MINIMISER_WORDS = 6
#: Words that a task gathers before it sends them on.
FLUSH_WORDS = 500_000
#: Bytes of text for each bucket; its strings are some 3.4 times as much.
BUCKET_BYTES = 1_000_000

_AT_BITS = 24


def super_kmers(ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each super-k-mer.

    ids: the words of all texts one after another; lengths: words of each text.
    """
    m = min(MINIMISER_WORDS, k)
    if len(ids) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(ids) >= 1 << _AT_BITS:  # positions would not fit: in parts whose windows follow one another
        cut = (1 << _AT_BITS) - k
        parts, starts = [], np.cumsum(lengths) - lengths
        for at in range(0, len(ids) - k + 1, cut):
            end = min(at + cut + k - 1, len(ids))
            own = np.clip(starts + lengths, at, end) - np.clip(starts, at, end)
            first, count, key = _of_some(ids[at:end], own, hashes, k, m)
            parts.append((first + at, count, key))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _of_some(ids, lengths, hashes, k, m)


def _of_some(ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``super_kmers`` of at least k words, fewer than ``_AT_BITS`` can number."""
    wh = hashes[ids]
    g = wh[: len(ids) - m + 1].copy()
    for i in range(1, m):
        g = _mixed(g * _MIX + wh[i : len(ids) - m + 1 + i])
    g = _mixed(g + _MIX)
    low = np.uint64((1 << _AT_BITS) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    span, width = k - m + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & low).astype(np.int64)  # of the window that starts here
    ends = np.cumsum(lengths)
    text_of = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    whole = np.arange(len(at)) + k <= ends[text_of]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text_of[1:] != text_of[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    count = np.add.reduceat(whole.astype(np.int64), np.flatnonzero(new))[whole[np.flatnonzero(new)]] if len(first) else np.zeros(0, np.int64)
    return first, count, g[at[first]]


def _send(docs: list[tuple], k: int, buckets: int) -> pa.RecordBatch | None:
    """Messages for one flush; docs: (doc_id, content, text), texts of k words at least."""
    docs = sorted(docs, key=lambda d: d[0])
    words = cut([d[2] for d in docs])
    ids, hashes = words.numbered()
    first, count, key = super_kmers(ids, words.counts, hashes, k)
    if not len(first):
        return None
    ends = np.cumsum(words.counts)
    doc = np.searchsorted(ends, first, side="right")
    doc_id = np.array([d[0] for d in docs], np.int64)[doc]
    content = np.array([d[1] for d in docs], np.int64)[doc]
    start = first - (ends - words.counts)[doc]
    bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    spaced, begins, stops = words.spaced.tobytes(), words.starts[first].tolist(), words.starts[first + count + k - 1].tolist()
    press, rows = zstandard.ZstdCompressor(level=3), []

    def packed(x: list[int]) -> bytes:
        return press.compress(b"".join((doc_id[x].tobytes(), content[x].tobytes(), start[x].tobytes(), count[x].tobytes())))

    for some in np.split(order, cuts):
        seen: dict[bytes, int] = {}
        strings, sent, again = [], [], []
        for i in some.tolist():
            s = spaced[begins[i] : stops[i]]
            j = seen.setdefault(s, i)
            if j == i or (doc_id[j] == doc_id[i] and start[j] == start[i]):
                strings.append(s)
                sent.append(i)
            else:
                again.append(i)
        rows.append((int(bucket[some[0]]), len(sent), packed(sent), press.compress(b"".join(strings)), len(again), packed(again)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "places", "words", "n_again", "again"])


def _places(data: bytes, n: int) -> np.ndarray:
    """4 rows: doc_id, content, first window, windows."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(4, n)


def repeated_windows(messages: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, content and start of each window of a bucket that also starts earlier."""
    places = [_places(m["places"], m["n"]) for m in messages if m["n"]]
    if not places:
        return (np.zeros(0, np.int64),) * 3
    doc, content, first, count = np.concatenate(places, axis=1)
    spaced = np.frombuffer(b"".join([zstandard.ZstdDecompressor().decompress(m["words"]) for m in messages if m["n"]]), np.uint8)
    ids, hashes = Words(spaced, np.concatenate([[0], np.flatnonzero(spaced == 0x20) + 1]), np.zeros(0, np.int64)).numbered()
    ids = ids.astype(np.int32)
    del spaced
    of = np.repeat(np.arange(len(count)), count)  # the string of each window
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(count + k - 1) - (count + k - 1), count) + inside  # its first word in ids
    wh = hashes[ids]
    rolled = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        rolled = rolled * _MIX + wh[i : len(ids) - k + 1 + i]
    h = _mixed(rolled[at])
    del rolled, wh
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    held = np.zeros(len(order), bool)
    held[1:] |= same
    held[:-1] |= same
    some = order[held]  # windows whose hash another one has
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    start = first[of] + inside
    key = h[some]
    by = np.lexsort((start[some], doc[of[some]], key))
    some, key = some[by], key[by]
    new = np.ones(len(some), bool)
    new[1:] = key[1:] != key[:-1]
    # the hash only groups; the words decide
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[group]
    equal = np.ones(len(some), bool)
    for i in range(k):
        equal &= ids[at[some] + i] == ids[at[some[lead]] + i]
    if not equal.all():
        for g in np.unique(group[~equal]):
            rows = np.flatnonzero(group == g)
            texts: dict[bytes, int] = {}
            for r in rows:
                lead[r] = texts.setdefault(ids[at[some[r]] : at[some[r]] + k].tobytes(), r)
    later = (doc[of[some]] != doc[of[some[lead]]]) | (start[some] != start[some[lead]])
    some = some[later]
    return doc[of[some]], content[of[some]], start[some]


def _ranges(doc: np.ndarray, content: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Windows start to start + count of a text, joined where they touch."""
    order = np.lexsort((start, content, doc))
    doc, content, start, end = doc[order], content[order], start[order], (start + count)[order]
    if not len(doc):
        return [doc, content, start, end]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (content[1:] != content[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return [doc[at], content[at], start[at], np.maximum.reduceat(end, at)]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, content (xxhash64 of the text), first and end: ranges of windows that also start
    earlier, in words; the words they cover are ``first`` to ``end + k - 1``, exclusive."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # the number of buckets grows with the text, so that a bucket's share does not
    buckets = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES))
    plain = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("content"), text.cast("binary").alias("text"))

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for some in sliced(batch, 2):
                for doc_id, content, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if len(text) >= 2 * k - 1:  # else too short for k words
                        held.append((doc_id, content, text))
                        n += len(text) // 6 + 1
                    if n >= FLUSH_WORDS:
                        if sent := _send(held, k, buckets):
                            yield sent
                        held, n = [], 0
        if held and (sent := _send(held, k, buckets)):
            yield sent

    def find(key, messages):
        rows = messages.to_pylist()
        doc, content, start = repeated_windows(rows, k)
        again = [_places(m["again"], m["n_again"]) for m in rows if m["n_again"]]
        found = _ranges(*np.concatenate([np.stack([doc, content, start, np.ones(len(doc), np.int64)]), *again], axis=1))
        del rows, again, doc, content, start
        trimmed()
        return pa.table(dict(zip(("doc_id", "content", "first", "end"), map(pa.array, found), strict=True)))

    sent = plain.mapInArrow(send, "bucket int, n long, places binary, words binary, n_again long, again binary")
    return sent.groupBy("bucket").applyInArrow(find, "doc_id long, content long, first long, end long")


def cut_words(text: str, ranges: list[tuple[int, int]], k: int) -> tuple[str, int, int]:
    """The text without the words that the ranges cover, its words, and those taken out. White space
    between words that stay is kept."""
    n = len(text.encode().split())
    if not ranges:
        return text, n, 0
    import re

    gone = np.zeros(n + 1, np.int64)
    for first, end in ranges:
        gone[first] += 1
        gone[min(n, end + k - 1)] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    out, at = [], 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if gone[i]:
            out.append(text[at : m.start()])
            at = m.end()
            while at < len(text) and text[at] in " \t\v\f\r":  # the break that followed the word goes with it
                at += 1
    out.append(text[at:])
    return "".join(out), n, int(gone.sum())


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS, counts: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with all its columns, its text without the words of repeated windows; with ``counts``,
    also the number of words, of removed words, and (if it has a third name) the SHA-256 in hex of the
    words that stay, joined by one space.

    A window is a repeat if its words also start in a document of a smaller id, or earlier in the
    same one; windows are judged on the input. Null text stays null and has no words; a null id
    counts as the smallest. Rows repeated with id and text start at the same place, so neither is
    the earlier one. A text without repeats is not changed. Columns may have any name and type. An
    empty table gives no rows.
    """
    counts = tuple(counts or ())
    small_batches(docs)
    spans, doc, content = (fresh(docs, x) for x in ("spans", "id", "content"))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.store(repeats(docs, id_col, text_col, k))
        ranges = store(found.groupBy("doc_id", "content").agg(F.collect_list(F.struct("first", "end")).alias(spans)))
    held = bitmap_of(ranges.select("content"))
    test, hashed = held.test(), fresh(docs, "hash")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(doc, F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn(content, F.xxhash64(text))
    # only texts that the bounded filter can't clear meet their ranges in a shuffle
    suspects = keyed.filter(held.column(F.xxhash64(content))).join(ranges.withColumnsRenamed({"doc_id": doc, "content": content}), [doc, content], "left")
    at = docs.columns.index(text_col)
    kinds = [T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(counts, kinds, strict=False))])

    def row(text: bytes | None, ranges: list[dict] | None) -> tuple:
        if text is None:
            return None, 0, 0, _sha256([])
        if not ranges:
            words = text.split() if counts else ()
            return text, len(words), 0, _sha256(words) if len(counts) > 2 else None
        out, n, gone = cut_words(text.decode(), [(r["first"], r["end"]) for r in ranges], k)
        out = out.encode()
        return out, n, gone, _sha256(out.split()) if len(counts) > 2 else None

    def finished(rows: pa.RecordBatch, width: int, ranges: list) -> pa.RecordBatch:
        got = [row(t, r) for t, r in zip(rows.column(at).cast(pa.binary()).to_pylist(), ranges, strict=True)]
        made = [pa.array([g[i] for g in got], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
        texts = pa.array([g[0] for g in got], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*(texts if i == at else c for i, c in enumerate(rows.columns[:width])), *made[: len(counts)]], names=schema.names)

    width = len(docs.columns)

    @released
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~test(batch.column(width).to_numpy())))
            for some in sliced(batch, at):
                yield finished(some, width, [None] * some.num_rows)

    @released
    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, at):
                yield finished(some, width, some.column(width).to_pylist())

    alone = keyed.select(*columns(docs), F.xxhash64(content).alias(hashed)).mapInArrow(clear, schema)
    return alone.unionByName(suspects.select(*columns(docs), spans).mapInArrow(shortened, schema))


def _sha256(words: list[bytes]) -> str:
    from hashlib import sha256

    return sha256(b" ".join(words)).hexdigest()
