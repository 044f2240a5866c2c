"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents of its own partition, so nothing is shuffled. A document of at least
one longest window gives whole windows first; what is left of it, and every shorter document, is
routed to the smallest tier that holds it. Tiers are packed from the longest to the shortest. The
gap in a window is filled by the largest waiting piece of a shorter tier that fits, and where none
fits, by a cut off the smallest one. Only the last window of a partition can stay open; it is dealt
out as shorter sequences whose lengths are powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import col, released, sliced, small_batches
from veridra.llm.words import cut

#: Windows, longest first; all powers of two.
TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Tokens of a step group, whatever the length of its sequences.
STEP_TOKENS = 65_536
#: Tokens that a task gathers before it packs them.
BUFFER_TOKENS = 2_000_000
#: Words whose ids a task remembers before it starts afresh: some 80 MB.
CACHE_WORDS = 400_000
#: A word that ends in one of these after an ASCII letter or digit has the ids of both parts, if the
#: tokenizer cuts it there; then it is taken as two words.
_TAILS = b".,;:!?"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])

_words: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of a word, as little-endian unsigned 32-bit bytes; unknown words are encoded in batches."""

    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise ImportError("this module needs a little-endian machine with 32-bit integers")

    def __init__(self, file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids(" a  b\n") != ids("a") + ids("b"):
            raise ValueError("the tokenizer does not drop white space between words")
        cuts = lambda text: self.tokenizer.pre_tokenizer is not None and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 2
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a word, if the tokenizer's ids tell.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        tails = bytes(c for c in _TAILS if cuts(f"a{chr(c)}") and cuts(f"1{chr(c)}"))
        self.apart = re.compile(rb"(?<=[0-9A-Za-z])([" + re.escape(tails) + rb"])(?=[\x20\x09-\x0D]|\Z)").sub if tails else None

    def learn(self, new: list[bytes]) -> None:
        encode = lambda texts: self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        other = new
        if self.ends is not None:  # words of letters are encoded many in a text, and told apart by their ends
            texts = list(map(bytes.decode, new))
            lettered = [w for w, t in zip(new, texts, strict=True) if t.isalpha()]
            other = [w for w, t in zip(new, texts, strict=True) if not t.isalpha()]
            for at in range(0, len(lettered), 20_000):
                some = lettered[at : at + 20_000]
                found = encode([b" ".join(some[i : i + 200]).decode() for i in range(0, len(some), 200)])
                ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(some):
                    other += some
                    continue
                raw, start = ids.tobytes(), 0
                for w, end in zip(some, (4 * ends).tolist(), strict=True):
                    self[w] = raw[start:end]
                    start = end
        for at in range(0, len(other), 5000):
            some = other[at : at + 5000]
            for w, e in zip(some, encode([w.decode() for w in some]), strict=True):
                self[w] = array("I", e.ids).tobytes()

    @classmethod
    def of(cls, file: str) -> WordIds:
        if file not in _words:
            _words[file] = cls(file)
        return _words[file]


def encode_words(texts: list[bytes | None], file: str) -> list[bytes]:
    """The ids of whole texts. The tokenizer drops white space and never joins two words, so that a
    text's ids are those of its words one after another. Special tokens in a text are found as the
    tokenizer finds them, in the spelling of the text."""
    known = WordIds.of(file)
    # the tokenizer's own lower case follows; where special tokens may be, case is theirs
    texts = [(t or b"") if t and b"<|" in t else (t or b"").lower() for t in texts]
    words = cut([known.apart(rb" \1", t) for t in texts] if known.apart else texts)
    number, each = words.coded()
    each = [w[:-1] for w in each.to_pylist()]
    if len(known) + len(each) > CACHE_WORDS:
        known.clear()
    known.learn([w for w in each if w not in known])
    # large: the ids of a long text may be more than 2**31 bytes
    ids = pa.array([known[w] for w in each], pa.large_binary()).take(pa.array(number))
    _, offsets, joined = ids.buffers()
    ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.cumsum([0, *words.counts])].tolist() if len(ids) else [0] * (len(texts) + 1)
    joined = joined.to_pybytes() if joined else b""
    return [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Packer:
    """Pieces wait by length; ``pack`` deals them out to windows."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int):
        self.tiers, self.step, self.base = tiers, step_tokens, base
        self.waiting: list[list[tuple]] = [[] for _ in range(tiers[0] + 1)]
        self.mask = 0  # bit n: a piece of n tokens waits
        self.tokens = 0
        self.n = 0
        self.step_of: dict[int, list[int]] = {}
        self.steps = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        top = self.tiers[0]
        for at in range(0, n - top + 1, top):
            self._emit([(doc_id, at, top, ids, n)])
        if n % top:
            self._wait((doc_id, n - n % top, n % top, ids if n < 4 * top else ids[4 * (n - n % top) :], n))

    def _wait(self, piece: tuple) -> None:
        self.waiting[piece[2]].append(piece)
        self.mask |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, length: int) -> tuple:
        held = self.waiting[length]
        piece = held.pop()
        if not held:
            self.mask ^= 1 << length
        self.tokens -= length
        return piece

    def pack(self, last: bool) -> None:
        while self.mask:
            size = next(t for t in reversed(self.tiers) if t >= self.mask.bit_length() - 1)
            if not last and self.tokens < size:
                return
            window, gap = [], size
            while gap and self.mask:
                fits = self.mask & ((1 << (gap + 1)) - 1)
                if fits:
                    window.append(p := self._take(fits.bit_length() - 1))
                else:
                    shortest = (self.mask & -self.mask).bit_length() - 1
                    doc, start, length, ids, n = self._take(shortest)
                    window.append(p := (doc, start, gap, ids, n))
                    self._wait((doc, start + gap, length - gap, ids, n))
                gap -= p[2]
            if not gap:
                self._emit(window)
            else:
                self._emit_open(window, size - gap)

    def _emit_open(self, window: list[tuple], total: int) -> None:
        """Sequences as long as the powers of two that make up ``total``."""
        room, now = 1 << (total.bit_length() - 1), []
        for doc, start, length, ids, n in window:
            while length:
                part = min(length, room)
                now.append((doc, start, part, ids, n))
                start, length, room, total = start + part, length - part, room - part, total - part
                if not room:
                    self._emit(now)
                    now, room = [], 1 << max(0, total.bit_length() - 1)

    def _emit(self, window: list[tuple]) -> None:
        size = sum(p[2] for p in window)
        tier = next((t for t in reversed(self.tiers) if t >= size))
        step = self.step_of.get(tier)
        if step is None or step[1] + size > self.step:
            step = self.step_of[tier] = [self.steps, 0]
            self.steps += 1
        step[1] += size
        at = 0
        for doc, start, length, ids, n in window:
            first = 4 * (start - (n - len(ids) // 4))
            self.rows.append((doc, start, length, zlib.crc32(memoryview(ids)[first : first + 4 * length]), n, self.base + self.n, at, size, tier, self.base + step[0]))
            at += length
        self.n += 1

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    tokenizer: a tokenizers file whose white space is dropped, readable on each worker. A null text
    is empty: its one token is ``end_id``. A null id stays null. Repeated rows are packed each for
    itself; columns other than id and text are not read. An empty table gives no rows. Sequence and
    step ids are unique over the table and the same when a lost task runs again. Step groups hold
    sequences of one tier, and ``step_tokens`` tokens each but for the last of a tier in a task.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers are powers of two, longest first")
    small_batches(docs)
    end = end_id.to_bytes(4, "little")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
        held = 0
        for batch in batches:
            for some in sliced(batch, 1, rows=2048):
                for doc_id, one in zip(some.column(0).to_pylist(), encode_words(some.column(1).to_pylist(), tokenizer), strict=True):
                    packer.add(doc_id, one + end)
                    held += len(one) // 4 + 1
                if held >= BUFFER_TOKENS:
                    packer.pack(last=False)
                    held = 0
                if len(packer.rows) > 5_000:
                    yield packer.drain()
        packer.pack(last=True)
        if packer.rows:
            yield packer.drain()
        WordIds.of(tokenizer).clear()

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
