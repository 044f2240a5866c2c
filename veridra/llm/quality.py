"""Quality rules: cross-document line frequency.

Lines are normalised (lower case, digits as 0, single spaces) and hashed. For every host the distinct
documents that hold a line are counted. Documents that are copies byte by byte count as one, among
those that hold a line and among the host's documents alike: copies are the business of dedup, and a
page copied a thousand times must not make its own lines frequent. Lines in more of a host's documents
than its limit are removed, and a document that loses most of its words is rejected. Each document is
also measured by itself. Texts are read once: their measures and hashed lines are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import Scratch, col, columns, fresh, released, sliced, small_batches, store
from veridra.llm.words import cut

#: A line is removed if more distinct documents of its host hold it than the larger of these two.
LIMIT_DOCS = 10
LIMIT_SHARE = 0.02
#: A document is rejected if a smaller share of its words is left.
LEAST_LEFT = 0.3
SYMBOLS = b"#*$%&|<>"
#: Parts that the lines of one host are dealt out to where they meet its frequent ones.
SALTS = 16

_DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _repeat_words(number: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the words that lie in three-word windows found twice or more in it; number: of
    each word of all texts."""
    out = np.zeros(len(counts), np.int64)
    if len(number) < 3:
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(text[:-2] == text[2:])
    bits = int(number.max()).bit_length()
    if len(counts).bit_length() + 3 * bits <= 62:
        key = (((text[at] << bits | number[at]) << bits | number[at + 1]) << bits) | number[at + 2]
    else:  # too many words for one key: number the windows word by word
        key = text[at]
        for i in range(3):
            key = np.unique(key * (int(number.max()) + 1) + number[at + i], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(number), bool)
    for i in range(3):
        cover[at[twice] + i] = True
    return np.bincount(text[cover], minlength=len(counts))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def measured(texts: list[bytes]) -> list[np.ndarray]:
    """The measures of each text, in the order of their names."""
    words = cut(texts)
    number, _ = words.coded()
    bounds = words.starts[np.cumsum([0, *words.counts])]
    chars = _per_text((words.spaced & 0xC0) != 0x80, bounds) - words.counts  # all but the spaces
    symbols = [sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) for t in texts]
    doubled = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        doubled.append(len(lines) - len(set(lines)))
    return [words.counts, chars, np.array(symbols, np.int64), np.array(doubled, np.int64), _repeat_words(number, words.counts)]


def text_lines(text: bytes) -> dict[int, int]:
    """Hash of each normalised line of a text, and the words of all its occurrences."""
    n: dict[int, int] = {}
    for line in text.split(b"\n"):
        if key := _line_key(line):
            n[key[0]] = n.get(key[0], 0) + key[1]
    return n


def _line_key(line: bytes) -> tuple[int, int] | None:
    """Hash (signed) and words of a line, None if it has none."""
    from xxhash import xxh3_64_intdigest

    words = line.translate(_DIGITS).lower().split()
    if not words:
        return None
    h = xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h, len(words)


def _read(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """row, host, c1 and c2 (128 bits that tell texts apart), doc_id, measures and lines of every row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(col(host_col).cast("string"), F.lit("")).alias("host"), *_content(text), col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, 5, size=1_000_000):
                texts = some.column(5).to_pylist()
                lines = pa.array([[{"line": k, "words": n} for k, n in text_lines(t).items()] for t in texts], _LINES)
                yield pa.RecordBatch.from_arrays([*some.columns[:5], *(pa.array(c, pa.int64()) for c in measured(texts)), lines], names=["row", "host", "c1", "c2", "doc_id", *_MEASURES, "lines"])

    return rows.mapInArrow(run, "row long, host string, c1 long, c2 long, doc_id long, " + ", ".join(f"{n} long" for n in _MEASURES) + ", lines array<struct<line:long,words:long>>")


def _content(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("again"), text).alias("c2")]


def frequent_lines(read: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """host and line of the lines above their host's limit.

    Copies are folded, and lines counted, before and after each shuffle, so a common line or a host
    with a third of all rows sends one row for each task.
    """
    texts = read.groupBy("host", "c1", "c2").agg(F.first("lines").alias("lines"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    n = texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit_docs)
    return n.join(hosts, "host").filter(F.col("n") > F.col("docs") * limit_share).select("host", "line")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per document: its measures, words_removed, base_failed and kept.

    Null text is empty, a null host is one host, that of the empty name; null ids and repeated rows
    are rated each for itself. Other columns are not read; an empty table gives no rows. A document
    is kept if its own measures pass and at least ``least_left`` of its words are left.
    """
    small_batches(docs)
    with Scratch(docs.sparkSession) as scratch:
        read = scratch.store(_read(docs, id_col, text_col, host_col))
        frequent = scratch.store(frequent_lines(read, limit_docs, limit_share)).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        lines = read.select("row", "host", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode("lines").alias("l")).select("row", "host", "salt", "l.line", "l.words")
        removed = lines.join(frequent, ["host", "line", "salt"]).groupBy("row").agg(F.sum("words").alias("words_removed"))
        rated = read.drop("lines", "host", "c1", "c2").join(removed, "row", "left").drop("row").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))
        return store(rated.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("words_removed") >= F.col("n_words") * least_left)))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The rows that ``rate`` keeps, with all their columns, of any name and type; their texts without
    the frequent lines.

    Null text is empty and so not kept; a null host is that of the empty name; null ids, ties and
    repeated rows are each for itself. An empty table stays empty.
    """
    text, host = F.coalesce(col(text_col).cast("string"), F.lit("")), F.coalesce(col(host_col).cast("string"), F.lit(""))
    small_batches(docs)
    with Scratch(docs.sparkSession) as scratch:
        read = scratch.store(_read(docs, id_col, text_col, host_col).select("host", "c1", "c2", "lines"))
        frequent = frequent_lines(read, limit_docs, limit_share)
        folded = read.groupBy("host", "c1", "c2").agg(F.first("lines").alias("lines"))
        hits = store(folded.select("host", "c1", "c2", F.explode("lines.line").alias("line")).join(frequent, ["host", "line"]).groupBy("host", "c1", "c2").agg(F.collect_list("line").alias("gone")))
    names = [fresh(docs, x) for x in ("host", "c1", "c2", "gone")]
    keyed = docs.withColumns({names[0]: host, **dict(zip(names[1:3], _content(text), strict=True))})
    joined = keyed.join(hits.toDF(*names), names[:3], "left").select(*columns(docs), names[3])
    at, width, schema = docs.columns.index(text_col), len(docs.columns), docs.schema

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, at):
                texts = [t or b"" for t in some.column(at).cast(pa.binary()).to_pylist()]
                n_words, *_, n_repeat = (c.tolist() for c in measured(texts))
                keep, out = [], []
                for t, n, again, drop in zip(texts, n_words, n_repeat, some.column(width).to_pylist(), strict=True):
                    gone = set(drop or ())
                    left = b"\n".join(x for x in t.split(b"\n") if not (k := _line_key(x)) or k[0] not in gone) if gone else t
                    keep.append(n >= 50 and 100 * again <= 50 * n and len(left.split()) >= n * least_left)
                    out.append(left)
                whole = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(some.columns[:width])]
                yield pa.RecordBatch.from_arrays(whole, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)
