"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks that run on a little into the next one; a short text is one chunk. Each
chunk is pre-tokenised on its own, those of longer texts wherever they land in the cluster. What a
pre-token is depends only on the characters from its start, so where a boundary of one chunk is also
one of the next, the two agree from there on: there they are stitched. Where the overlap holds no
such place (one word that runs through it, say), pre-tokens are matched one by one from the last sure
boundary until they meet one of the next chunk's. Then the pre-tokens are merged by rank. Decoding
joins the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import col, released, sliced, small_batches

CHUNK_CHARS = 16_384
#: Characters of the next chunk that a chunk holds too.
OVERLAP_CHARS = 256
#: So many characters behind a boundary may have decided it, so one this close to a cut is not sure.
LOOKAHEAD = 8
#: Pre-tokens whose ids a worker remembers, each of at most so many characters: some 20 MB.
CACHE_PIECES, CACHED_CHARS = 100_000, 48

_coders: dict[tuple[str, str], "Coder"] = {}


class Coder(dict):
    """Ids of a pre-token as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_file: str, pattern: str):
        super().__init__()
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        # \s is Unicode's White_Space in the pattern's own dialect
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids

    @classmethod
    def of(cls, ranks_file: str, pattern: str) -> Coder:
        if (ranks_file, pattern) not in _coders:
            _coders[ranks_file, pattern] = cls(ranks_file, pattern)
        return _coders[ranks_file, pattern]

    def boundaries(self, start: int, chunk: str, last: bool) -> np.ndarray:
        """Ends, in the whole text, of a chunk's pre-tokens: those that no later character can move."""
        ends = np.cumsum(np.fromiter(map(len, self.pattern.findall(chunk)), np.int64))
        if len(chunk) != (ends[-1] if len(ends) else 0):
            raise ValueError("the pattern leaves characters out")
        return (ends if last else ends[ends <= len(chunk) - LOOKAHEAD]) + start

    def stitched(self, text: str, parts: list[tuple[int, np.ndarray]]) -> list[int]:
        """Ends of the text's pre-tokens from its chunks' starts and boundaries, in order."""
        out: list[int] = []
        at = 0  # the last sure boundary
        for start, ends in parts:
            if at != start and len(ends) and at < ends[-1]:
                met = set(ends.tolist())
                while at not in met and at < ends[-1]:
                    at = self.pattern.match(text, at).end()
                    out.append(at)
            out += ends[np.searchsorted(ends, at, side="right") :].tolist()
            at = out[-1] if out else 0
        return out

    def encoded(self, text: str, parts: list[tuple[int, np.ndarray]]) -> bytes:
        ends = self.stitched(text, parts)
        return b"".join([self[text[a:b]] for a, b in zip([0, *ends], ends, strict=False)])

    def encode(self, text: str, size: int = CHUNK_CHARS) -> bytes:
        """The ids of a text whose chunks are all at hand."""
        return self.encoded(text, [(start, self.boundaries(start, chunk, last)) for start, chunk, last in chunks(text, size)])


def chunks(text: str, size: int) -> Iterator[tuple[int, str, bool]]:
    """Start and text of each chunk, and whether it reaches the end; the first that does is the last."""
    for start in range(0, max(1, len(text)), size):
        last = start + size + OVERLAP_CHARS >= len(text)
        yield start, text[start : start + size + OVERLAP_CHARS], last
        if last:
            return


def decoder(ranks_file: str, pattern: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A function that adds to batches of doc_id and ids ``bytes``, the bytes of the ids joined, and
    ``ids_text``, the ids in decimal joined by one space. A null ``ids`` is empty; an id that has no
    rank is an error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder.of(ranks_file, pattern)
        out, texts = [], []
        for ids in batch.column(1):
            ids = np.frombuffer(ids.as_py() or b"", "<u4").tolist()
            out.append(b"".join(map(coder.bytes_of.__getitem__, ids)))
            texts.append(" ".join(map(coder.text_of.__getitem__, ids)))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "bytes", "ids_text"])

    return run


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) for every row.

    ranks_file: a tiktoken file that each worker can read. The pattern's pre-tokens cover every
    character and are decided by what they hold and the few characters behind them. Null text is empty
    and has no ids; special tokens are ordinary text. Repeated rows and null ids are encoded each for
    itself; other columns are not read. An empty table gives no rows. Only chunks of texts of more
    than one are dealt out (with ``OVERLAP_CHARS`` more characters each); a text and its ids must fit
    into one cell. then: is given each batch of results in the worker that made it, so that what
    follows needs no pass of its own; ``schema`` is of what it returns.
    """
    small_batches(docs)
    plain = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    many = F.length("text") > chunk_chars + OVERLAP_CHARS  # two chunks or more

    def finished(ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([ids, pa.array(encoded, pa.binary())], names=["doc_id", "ids"])
        return then(out) if then else out

    @released
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks_file, pattern)
        for batch in batches:
            for some in sliced(batch, 1, size=1_000_000):
                yield finished(some.column(0), [coder.encode(t, chunk_chars) for t in some.column(1).to_pylist()])
        coder.clear()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc_id, text = (c[i].as_py() for c in batch.columns)
                held: list[tuple] = []
                for start, chunk, last in chunks(text, chunk_chars):
                    held.append((row, doc_id, start, last, chunk))
                    if last or len(held) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["row", "doc_id", "start", "last", "chunk"])
                        held = []

    @released
    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks_file, pattern)
        for batch in batches:
            for some in sliced(batch, 4, size=1_000_000):
                rows = some.select(["start", "last", "chunk"]).to_pylist()
                ends = [np.diff(coder.boundaries(r["start"], r["chunk"], r["last"]), prepend=r["start"]).astype("<u4").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([r["chunk"] if r["last"] else r["chunk"][:chunk_chars] for r in rows], pa.string()), pa.array(ends, pa.binary())], names=["row", "doc_id", "start", "chunk", "ends"])

    def stitched(key, parts):
        rows = sorted(parts.select(["start", "chunk", "ends"]).to_pylist(), key=lambda r: r["start"])
        text = "".join(r["chunk"] for r in rows)
        ids = Coder.of(ranks_file, pattern).encoded(text, [(r["start"], np.cumsum(np.frombuffer(r["ends"], "<u4"), dtype=np.int64) + r["start"]) for r in rows])
        return pa.Table.from_batches([finished(parts.column("doc_id").slice(0, 1).combine_chunks().cast(pa.int64()), [ids])])

    one = plain.filter(~many).select("doc_id", "text").mapInArrow(whole, schema)
    dealt = plain.filter(many).mapInArrow(split, "row long, doc_id long, start long, last boolean, chunk string").repartition("row", "start")
    parts = dealt.mapInArrow(pretokenised, "row long, doc_id long, start long, chunk string, ends binary")
    return one.unionByName(parts.groupBy("row").applyInArrow(stitched, schema))


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes`` and ``ids_text``; see ``decoder``."""
    add = decoder(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(add, sliced(batch, 1, rows=64))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary, ids_text string")
