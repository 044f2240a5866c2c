"""LM scoring by a hierarchical Pitman-Yor model.

The restaurant of a context is the seating of the words that follow it. All contexts share one parent,
the restaurant of words without context, whose customers are their tables; its own parent is uniform
over the words and one unknown word. Seating is sampled by Gibbs, all restaurants at a time: in each
sweep the contexts draw their tables given the parent's predictive probabilities, then the parent
draws its own given the contexts' tables, and its new probabilities go back to the contexts. What is
given is the state of the sweep before. Predictive probabilities are averaged over the last sweeps.

How it is dealt out, in one plan:

* A first pass counts the tokens of hash bins of contexts. The number of buckets follows from the
  tokens; bins with too many of them for a bucket are split by the word that follows.
* Tasks send, for each bucket, the distinct (context, word) pairs of a run of documents, with the
  documents that hold them: training and held-out ones alike.
* In each round buckets ask the owners of their words with their parts of counts and tables, and
  owners answer with the sums and with the parent's tables; they do the same for contexts that are
  split over buckets. What a bucket has to remember travels with its questions and comes back.
* At last a bucket scores its pairs and sends to each run of documents the scores' parts, of those
  documents alone that hold a pair of the bucket.

Every draw takes its random numbers from the hash of its pair, sums are of whole numbers, discounts
and strengths come from sums over all buckets, and the numbers of buckets and owners from the tokens:
so scores do not depend on partition settings.

The tables of a dish are drawn by seating its customers one after another (in blocks of an eighth of
those that sit already, so customers sit one by one up to sixteen and a dish of c customers takes some
log c steps), with the hazard of a new table that the state gives and a power for what a table means to the later
ones; draws of the same dish are then weighed against each other, as that power is approximate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import col, owner_of, released, sliced, small_batches, trimmed
from veridra.llm.words import MIX, cut, mixed

FLUSH_TOKENS = 1_000_000
#: Tokens of a bucket, and the least that a bucket is made for, about; tokens for each owner of words.
BUCKET_TOKENS, LEAST_TOKENS, OWNER_TOKENS = 2_500_000, 50_000, 8_000_000
#: So many buckets are made before they are filled.
FEW_BUCKETS = 24
BURN_IN, SAMPLES = 1, 2
SWEEPS = BURN_IN + SAMPLES
#: Draws of a dish's tables that are weighed against each other.
PROPOSALS = 3
#: Strengths of the context restaurants, chosen from by leave-one-out, and the first sweep's.
STRENGTHS = (0.5, 5.0, 50.0, 500.0, 5000.0)
FIRST_STRENGTH = 5.0
#: Strength of the parent restaurant.
PARENT_STRENGTH = 10.0
#: Steps that parts of a score are sent in: sums over b buckets are off by less than b times half of it.
SCORE_STEP, BASE_STEP = 2.0**-30, 2.0**-36

#: Hashes of the end of a text and of its beginning, as no word's hash is likely to be.
_END, _BEGIN = 0x5BF0_3635_D2A3_9B11, 0xA1E2_77C4_0F9D_3B57
_BIN_BITS = 14
_U4 = (1 << 32) - 1


def _by_byte(a: np.ndarray) -> bytes:
    """First bytes, second bytes and so on, as numbers of like size compress best; hashes as they are."""
    if a.dtype.itemsize == 1 or a.dtype == np.uint64:
        return a.tobytes()
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    kinds = "".join(f"{a.dtype.str.strip('|<')} " for a in arrays).encode()
    head = struct.pack(f"<{len(arrays) + 2}I", len(arrays), len(kinds), *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(head + kinds + b"".join(map(_by_byte, arrays)))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width = struct.unpack_from("<2I", raw)
    sizes = struct.unpack_from(f"<{n}I", raw, 8)
    at = 8 + 4 * n
    kinds = raw[at : at + width].decode().split()
    at += width
    out = []
    for kind, size in zip(kinds, sizes, strict=True):
        item = np.dtype(kind).itemsize
        if item == 1 or kind == "u8":
            out.append(np.frombuffer(raw, kind, size // item, at))
        else:
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(item, -1)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of rising numbers below 2**32, which ``np.cumsum`` undoes."""
    return np.diff(a, prepend=0).astype(np.uint32)


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BIN_BITS)).astype(np.int64)


def layout(docs: DataFrame, text_at: int) -> tuple[int, int, np.ndarray]:
    """Buckets, owners, and for each hash bin of contexts the parts that it is split into."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _BIN_BITS, np.int64)
        begin = int(_bin(np.array([_BEGIN], np.uint64))[0])
        for batch in batches:
            for some in sliced(batch, text_at):
                texts = [(t or b"").lower() for t in some.column(text_at).to_pylist()]
                number, hashes = cut(texts).numbered()
                n += np.bincount(_bin(hashes), np.bincount(number, minlength=len(hashes)), len(n)).astype(np.int64)
                n[begin] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([zstandard.compress(n.tobytes())], pa.binary())], names=["part", "n"])

    def add(parts: list[bytes]) -> np.ndarray:
        return sum((np.frombuffer(zstandard.decompress(p), np.int64) for p in parts), np.zeros(1 << _BIN_BITS, np.int64))

    def summed(key, rows):
        return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([zstandard.compress(add(rows.column("n").to_pylist()).tobytes())], pa.binary())})

    # a row of 128 kB at most for each of 64 parts
    rows = docs.mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(summed, "part int, n binary").collect()
    n = add([bytes(r.n) for r in rows])
    tokens = int(n.sum())
    buckets = max(1, -(-tokens // BUCKET_TOKENS), min(FEW_BUCKETS, -(-tokens // LEAST_TOKENS)))
    parts = np.minimum(buckets, -(-4 * buckets * n // max(1, tokens)))
    return buckets, max(1, -(-tokens // OWNER_TOKENS)), np.where(parts > 2, parts, 1)


def _send(run: int, docs: list[tuple], buckets: int, split: np.ndarray) -> pa.RecordBatch:
    """One message for each bucket; docs: doc_id, train, text. The first one has the table of the run's
    documents with it."""
    ids, train, texts = zip(*docs, strict=True)
    words = cut([t.lower() for t in texts])
    number, hashes = words.numbered()
    hashes = np.concatenate([hashes, np.array([_END, _BEGIN], np.uint64)])
    end, begin = len(hashes) - 2, len(hashes) - 1
    lengths = words.counts + 1
    ends = np.cumsum(lengths)
    wid = np.full(int(ends[-1]), end, np.int64)
    inside = np.ones(len(wid), bool)
    inside[ends - 1] = False
    wid[inside] = number
    uid = np.empty_like(wid)
    uid[1:] = wid[:-1]
    uid[ends - lengths] = begin
    doc = np.repeat(np.arange(len(docs)), lengths)
    mixed_up = mixed(hashes + MIX)
    parts = split[_bin(hashes)].astype(np.uint64)[uid]
    place = mixed_up[uid]
    some = np.flatnonzero(parts > 1)
    place[some] = mixed(place[some] + mixed_up[wid[some]] % parts[some] * MIX)
    bucket = (place % np.uint64(buckets)).astype(np.int64)
    key = (uid << 32) | wid
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")]
    key, doc, bucket = key[order], doc[order], bucket[order]
    new_pair = np.ones(len(key), bool)
    new_pair[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    new_row = new_pair.copy()
    new_row[1:] |= doc[1:] != doc[:-1]
    row_at = np.flatnonzero(new_row)
    row_n = np.diff(row_at, append=len(key))
    row_doc, row_new = doc[row_at], new_pair[row_at]
    learnt = np.array(train, bool)[row_doc]
    pair_at = np.flatnonzero(row_new)
    pair_key, pair_bucket = key[row_at[pair_at]], bucket[row_at[pair_at]]
    pair_rows = np.diff(pair_at, append=len(row_at))
    pair_c = np.add.reduceat(row_n * learnt, pair_at)
    row_ends = np.cumsum(pair_rows)
    cuts = np.flatnonzero(np.diff(pair_bucket, prepend=-1))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair_key)], strict=True):
        ra, rb = (int(row_ends[a - 1]) if a else 0), int(row_ends[b - 1])
        u, w = pair_key[a:b] >> 32, pair_key[a:b] & _U4
        u_at = np.flatnonzero(np.diff(u, prepend=-1))
        held, w = np.unique(w, return_inverse=True)
        pairs = _pack(hashes[u[u_at]], np.diff(u_at, append=b - a).astype(np.uint32), hashes[held], w.astype(np.uint32), pair_c[a:b].astype(np.uint32))
        rows = _pack(np.array([run], np.int64), pair_rows[a:b].astype(np.uint32), row_doc[ra:rb].astype(np.uint32), row_n[ra:rb].astype(np.uint32))
        out.append((int(pair_bucket[a]), pairs, rows, b""))
    known = np.array([i is not None for i in ids])
    out[0] = (*out[0][:3], _pack(np.array([i or 0 for i in ids], np.int64), known.astype(np.uint8), lengths.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "pairs", "rows", "table"])


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key and salt, always the same."""
    x = key + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def _binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Binomial draws by inversion; those of a variance over 30 by its normal limit."""
    u = _uniform(key, 2 * salt)
    one = n == 1
    if one.all():
        return (u < p).astype(np.int64)
    out = np.where(one, u < p, 0).astype(np.int64)
    rest = np.flatnonzero(~one)
    flip = p[rest] > 0.5
    n_, p_, u_ = n[rest], np.where(flip, 1 - p[rest], p[rest]), u[rest]
    var = n_ * p_ * (1 - p_)
    z = np.sqrt(-2 * np.log(u_)) * np.cos(2 * np.pi * _uniform(key[rest], 2 * salt + 1))
    got = np.clip(np.rint(n_ * p_ + np.sqrt(var) * z), 0, n_).astype(np.int64)
    live = np.flatnonzero(var <= 30)
    got[live] = 0
    pmf = (1 - p_[live]) ** n_[live]
    below, k = pmf.copy(), 0
    while len(live):
        go = (u_[live] > below) & (k < n_[live])
        live, pmf, below = live[go], pmf[go], below[go]
        pmf = pmf * (n_[live] - k) / (k + 1) * p_[live] / (1 - p_[live])
        below = below + pmf
        k += 1
        got[live] = k
    out[rest] = np.where(flip, n_ - got, got)
    return out


def seat(c: np.ndarray, others: np.ndarray, theta: float, d: float, p: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers of tables of dishes with c customers (1 at least) each.

    others: tables of the restaurant's other dishes; p: the parent's probability of the dish; key and
    salt: where the random numbers come from.
    """
    order = np.argsort(-c, kind="stable")
    c_, others, p, key = c[order], others[order].astype(float), p[order], key[order]
    out, weight = np.ones(len(c), np.int64), None
    for draw in range(PROPOSALS):
        t, logs, n, step = np.ones(len(c), np.int64), np.zeros(len(c)), 1, 0
        while live := int(np.searchsorted(-c_, -n, side="left")):  # dishes with customers that still stand
            size = np.minimum(max(1, n // 8), c_[:live] - n)
            new = (theta + d * (others[:live] + t[:live])) * p[:live]
            now = n + (size - 1) / 2
            stay = now - d * t[:live]
            # a table makes the seats of all later customers scarcer, by about this power
            rest = new - d * t[:live]
            later = d * (1 - p[:live]) * np.log((now + 1 + rest) / np.maximum(c_[:live] + rest, now + 1 + rest))
            new = new * np.exp(later)
            more = _binomial(size, new / (new + stay), key[:live], (salt * PROPOSALS + draw) * 4096 + step)
            t[:live] += more
            logs[:live] += size * np.log(new + stay) - more * later
            n, step = n + max(1, n // 8), step + 1
        if weight is None:
            out, weight = t, logs
        else:
            take = np.log(_uniform(key, ((salt * PROPOSALS + draw) * 4096 + 4095) * 2)) < logs - weight
            out, weight = np.where(take, t, out), np.where(take, logs, weight)
    back = np.empty_like(out)
    back[order] = out
    return back


class Bucket:
    """The pairs of a bucket: contexts and words by hash, in rising order, and training counts."""

    def __init__(self, messages: list[bytes], split: np.ndarray, owners: int):
        parsed = [_unpack(m) for m in messages]
        context, at_context = np.unique(np.concatenate([x[0] for x in parsed]), return_inverse=True)
        words, at_word = np.unique(np.concatenate([x[2] for x in parsed]), return_inverse=True)
        keys, u_from, w_from = [], 0, 0
        for u, runs, w, pair_w, _ in parsed:
            keys.append(np.repeat(at_context[u_from : u_from + len(u)], runs) << 32 | at_word[w_from : w_from + len(w)][pair_w])
            u_from, w_from = u_from + len(u), w_from + len(w)
        key, self.pair_of = np.unique(np.concatenate(keys), return_inverse=True)
        self.c = np.bincount(self.pair_of, np.concatenate([x[4] for x in parsed]), len(key)).astype(np.int64)
        self.context, self.words, self.owners = context, words, owners
        self.r, self.w = key >> 32, key & _U4
        self.learnt = np.flatnonzero(self.c > 0)
        self.many = np.flatnonzero(self.c > 1)
        self.hot = np.flatnonzero(split[_bin(context)] > 1)
        self.word_at = np.searchsorted(owner_of(words, owners), np.arange(owners + 1))
        self.hot_at = np.searchsorted(owner_of(context[self.hot], owners), np.arange(owners + 1))

    def keys(self) -> np.ndarray:
        return mixed(self.context[self.r[self.many]] * MIX + self.words[self.w[self.many]])

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of every pair, from those of the pairs of many customers."""
        out = np.zeros(len(self.c), np.int64)
        out[self.learnt] = 1
        out[self.many] = t
        return out

    def of_words(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, x, len(self.words)).astype(np.int64)

    def of_contexts(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, x, len(self.context)).astype(np.int64)

    def asked(self, number: int, scalars: np.ndarray, words: list[np.ndarray], hot: list[np.ndarray], carry: bytes) -> list[tuple]:
        """Rows owner, bucket, request and carry, one for each owner; the carry goes with one of them."""
        out = []
        for o in range(self.owners):
            a, b, x, y = *self.word_at[o : o + 2], *self.hot_at[o : o + 2]
            out.append((o, number, _pack(scalars, *(_part(v, a, b) for v in words), *(_part(v, x, y) for v in hot)), carry if o == number % self.owners else b""))
        return out


def _part(v: np.ndarray, a: int, b: int) -> np.ndarray:
    return v[a:b]


def first_questions(number: int, b: Bucket) -> list[tuple]:
    """Hashes, training counts and numbers of pairs; the numbers of pairs with one and two customers."""
    ones = b.tables(np.ones(len(b.many), np.int64))
    scalars = np.array([(b.c == 1).sum(), (b.c == 2).sum()], np.float64)
    return b.asked(number, scalars, [b.words, b.of_words(b.c), b.of_words(ones)], [b.context[b.hot], b.of_contexts(b.c)[b.hot], b.of_contexts(ones)[b.hot]], b"")


def first_answers(owner: int, messages: list[dict]) -> list[tuple]:
    """Sums, and slots, by which words and contexts go from now on; the parent starts with a table for
    each word."""
    parsed = [_unpack(m["request"]) for m in messages]
    pairs = np.sum([x[0] for x in parsed], axis=0)
    word, c, t = _summed([x[1] for x in parsed], [[x[i] for x in parsed] for i in (2, 3)])
    hot, c_u, t_u = _summed([x[4] for x in parsed], [[x[i] for x in parsed] for i in (5, 6)])
    s = (t > 0).astype(np.int64)
    totals = np.array([c.sum(), (c > 0).sum(), t.sum(), s.sum(), (t == 1).sum(), (t == 2).sum(), *pairs], np.float64)
    out, w_from, h_from = [], 0, 0
    for m, x in zip(messages, parsed, strict=True):
        w, h = word[w_from : w_from + len(x[1])], hot[h_from : h_from + len(x[4])]
        w_from, h_from = w_from + len(x[1]), h_from + len(x[4])
        out.append((m["bucket"], owner, _pack(totals, _steps(w), c[w], t[w], s[w], _steps(h), c_u[h], t_u[h]), m["carry"]))
    return out


def _summed(keys: list[np.ndarray], columns: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """For each key of each message its place among the distinct ones, and sums of columns by place."""
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return inverse, *(np.bincount(inverse, np.concatenate(c), len(every)).astype(np.int64) for c in columns)


class State:
    """What a bucket knows from the answers to its last questions and from what it carries."""

    def __init__(self, answers: list[dict], b: Bucket, first: bool):
        answers = sorted(answers, key=lambda m: m["owner"])
        parsed = [_unpack(m["answer"]) for m in answers]
        whole = lambda i: np.concatenate([x[i] for x in parsed])
        slots = lambda i: np.concatenate([np.cumsum(x[i], dtype=np.int64) for x in parsed])
        totals = [x[0] for x in parsed]
        self.slot, self.c_w, self.t_w, self.s_w = slots(1), whole(2), whole(3), whole(4)
        self.hot, self.hot_c, self.hot_t = slots(5), whole(6), whole(7)
        self.n, self.v, self.customers, self.tables = (sum(float(x[i]) for x in totals) for i in range(4))
        carry = next((m["carry"] for m in answers if m["carry"]), b"")
        if first:
            m1, m2 = (sum(float(x[i]) for x in totals) for i in (4, 5))
            n1, n2 = totals[0][6:8].tolist()
            share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
            self.d, self.d_parent, self.theta = share(n1, n2), share(m1, m2), FIRST_STRENGTH
            self.t = np.ones(len(b.many), np.int64)
            self.samples: list[list[np.ndarray]] = []
        else:
            fixed, self.t, *rest = _unpack(carry)
            self.d, self.d_parent, self.theta, self.n, self.v = fixed.tolist()
            self.samples = [rest[i : i + 5] for i in range(0, len(rest), 5)]
            fits = totals[0][4:]
            if len(fits):  # of the first sweep
                self.theta = STRENGTHS[int(np.argmax(fits))]

    def parent(self) -> np.ndarray:
        """The parent's probability of each of the bucket's words."""
        return _parent(self.t_w, self.s_w, self.customers, self.tables, self.d_parent, self.v)

    def kept(self) -> bytes:
        return _pack(np.array([self.d, self.d_parent, self.theta, self.n, self.v]), self.t, *(x for s in self.samples for x in s))


def _parent(t: np.ndarray, s: np.ndarray, customers: float, tables: float, d: float, v: float) -> np.ndarray:
    return (t - d * s + (PARENT_STRENGTH + d * tables) / (v + 1)) / (PARENT_STRENGTH + customers)


def _fits(b: Bucket, x: State, t_u: np.ndarray, parent: np.ndarray) -> list[float]:
    """For each strength the log-probability of every training token, told from all others."""
    c_u = b.of_contexts(b.c)
    c_u[b.hot] = x.hot_c
    c, r, p = b.c[b.learnt], b.r[b.learnt], parent[b.w[b.learnt]]
    c_u, t_u = c_u[r].astype(float), t_u[r].astype(float)
    one = c == 1
    out = []
    for theta in STRENGTHS:
        more = c * np.log(np.maximum(c - 1 - x.d, 0) + (theta + x.d * t_u) * p)
        out.append(float((np.where(one, np.log((theta + x.d * (t_u - 1)) * p), more) - c * np.log(theta + c_u - 1)).sum()))
    return out


def sweep(number: int, b: Bucket, answers: list[dict], k: int, sweeps: int = SWEEPS, samples: int = SAMPLES) -> list[tuple]:
    """The contexts' part of sweep k (from 1): new tables of all dishes, and their sums."""
    x = State(answers, b, k == 1)
    if k - 1 > sweeps - samples:
        x.samples.append([x.t, x.t_w, x.s_w, x.hot_t, np.array([x.customers, x.tables])])
    t_u = b.of_contexts(b.tables(x.t))
    t_u[b.hot] = x.hot_t
    parent = x.parent()
    scalars = [x.v, x.tables, x.d_parent, *(_fits(b, x, t_u, parent) if k == 1 else ())]
    x.t = seat(b.c[b.many], t_u[b.r[b.many]] - x.t, x.theta, x.d, parent[b.w[b.many]], b.keys(), k)
    new = b.tables(x.t)
    last = k == sweeps
    none = np.zeros(0, np.int64)
    words = [x.slot, b.of_words(new), x.s_w, b.of_words(b.c) if last else none]
    hot = [x.hot, b.of_contexts(new)[b.hot], b.of_contexts(b.c)[b.hot] if last else none]
    return b.asked(number, np.array(scalars), words, hot, x.kept())


def sweep_answers(owner: int, messages: list[dict], k: int) -> list[tuple]:
    """The parent's part of a sweep."""
    parsed = [_unpack(m["request"]) for m in messages]
    v, tables, d, *_ = parsed[0][0].tolist()
    fits = np.sum([x[0][3:] for x in parsed], axis=0)
    slots, hots = [np.asarray(x[1]) for x in parsed], [np.asarray(x[5]) for x in parsed]
    size = lambda some: max((int(s[-1]) + 1 for s in some if len(s)), default=0)
    add = lambda some, i, n: np.bincount(np.concatenate(some), np.concatenate([x[i] for x in parsed]), n).astype(np.int64)
    n, m = size(slots), size(hots)
    t, t_u = add(slots, 2, n), add(hots, 6, m)
    last = any(len(x[4]) for x in parsed) or any(len(x[7]) for x in parsed)
    c, c_u = (add(slots, 4, n), add(hots, 7, m)) if last else (np.zeros(n, np.int64), np.zeros(m, np.int64))
    before = np.zeros(n, np.int64)
    before[np.concatenate(slots)] = np.concatenate([x[3] for x in parsed])
    s = (t > 0).astype(np.int64)
    many = np.flatnonzero(t > 1)
    key = mixed((np.uint64(owner + 1) << np.uint64(32)) + many.astype(np.uint64))
    s[many] = seat(t[many], tables - before[many], PARENT_STRENGTH, d, np.full(len(many), 1 / (v + 1)), key, 1000 + k)
    totals = np.array([0, 0, t.sum(), s.sum(), *fits], np.float64)
    out = []
    for msg, w, h in zip(messages, slots, hots, strict=True):
        out.append((msg["bucket"], owner, _pack(totals, _steps(w), c[w], t[w], s[w], _steps(h), c_u[h], t_u[h]), msg["carry"]))
    return out


def predictive(b: Bucket, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, State]:
    """The averaged probability of every pair, and the base probability of every word."""
    x = State(answers, b, False)
    c_u = b.of_contexts(b.c)
    c_u[b.hot] = x.hot_c
    p = np.zeros(len(b.c))
    every = [*x.samples, [x.t, x.t_w, x.s_w, x.hot_t, np.array([x.customers, x.tables])]]
    for t, t_w, s_w, hot_t, (customers, tables) in every:
        parent = _parent(t_w, s_w, customers, tables, x.d_parent, x.v)
        pair_t = b.tables(t)
        t_u = b.of_contexts(pair_t)
        t_u[b.hot] = hot_t
        known = c_u[b.r]
        p += np.where(known > 0, (b.c - x.d * pair_t + (x.theta + x.d * t_u[b.r]) * parent[b.w]) / (x.theta + known), parent[b.w])
    base = (x.c_w + 0.5) / (x.n + 0.5 * (x.v + 1))
    return p / len(every), base, x


def parts_of_scores(b: Bucket, rows: list[bytes], tables: list[bytes], answers: list[dict]) -> list[tuple]:
    """For each run: its number, this bucket's part of its documents' scores, their table if it came
    here, and the training tokens."""
    p, base, x = predictive(b, answers)
    logs, of_word = np.log10(p), np.log10(base)
    out, at = [], 0
    for raw, table in zip(rows, tables, strict=True):
        run, pair_rows, doc, n = _unpack(raw)
        pair = np.repeat(b.pair_of[at : at + len(pair_rows)], pair_rows)
        at += len(pair_rows)
        w = b.w[pair]
        docs, of = np.unique(doc, return_inverse=True)
        score = np.rint(np.bincount(of, n * logs[pair]) / SCORE_STEP).astype(np.int64)
        first = np.rint(np.bincount(of, n * of_word[w]) / BASE_STEP).astype(np.int64)
        known = np.bincount(of, n * (x.c_w[w] > 0)).astype(np.uint32)
        # scores are never positive
        out.append((int(run[0]), _pack(_steps(docs), -score, -first, known), table, int(x.n)))
    return out


def gathered(messages: list[dict]) -> pa.Table:
    ids, known, lengths = _unpack(next(m["table"] for m in messages if m["table"]))
    sums = [np.zeros(len(ids), np.int64) for _ in range(3)]
    for m in messages:
        docs, *parts = _unpack(m["part"])
        docs = np.cumsum(docs, dtype=np.int64)
        for total, part in zip(sums, parts, strict=True):
            total[docs] += part
    n = messages[0]["train_tokens"]
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "n_tokens": pa.array(lengths), "n_known": pa.array(sums[2]), "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(sums[1] * -BASE_STEP), "score": pa.array(sums[0] * -SCORE_STEP)})


_ASKED = "owner int, bucket int, request binary, carry binary"
_ANSWERED = "bucket int, owner int, answer binary, carry binary"


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row.

    train: whether a row is learnt from. Tokens are the words, lower-cased in A-Z, and one end; null
    text has the end alone. base_score is the add-half unigram model's log10 probability, score the
    hierarchical model's; both are sums of parts rounded to ``BASE_STEP`` and ``SCORE_STEP``. Null ids
    and repeated rows are scored each for itself; other columns are not read. An empty table gives no
    rows; without training rows all words are alike.
    """
    small_batches(docs)
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), col(text_col).cast("binary").alias("text"))
    buckets, owners, split = layout(plain, 2)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, run = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in sliced(batch, 2):
                for doc_id, learn, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    held.append((doc_id, learn, text or b""))
                    n += len(text or b"") // 6 + 1
                    if n >= FLUSH_TOKENS:
                        yield _send(run, held, buckets, split)
                        held, n, run = [], 0, run + 1
        if held:
            yield _send(run, held, buckets, split)

    def asked(rows: list[tuple]) -> pa.Table:
        trimmed()
        return _table(rows, ("owner", "bucket", "request", "carry"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    def answered(rows: list[tuple]) -> pa.Table:
        return _table(rows, ("bucket", "owner", "answer", "carry"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    def bucket(messages: pa.Table) -> Bucket:
        return Bucket(messages.column("pairs").to_pylist(), split, owners)

    def ask(key, messages):
        return asked(first_questions(key[0].as_py(), bucket(messages)))

    def answer(k: int):
        def run(key, messages):
            rows = sorted(messages.select(["bucket", "request", "carry"]).to_pylist(), key=lambda m: m["bucket"])
            return answered(sweep_answers(key[0].as_py(), rows, k) if k else first_answers(key[0].as_py(), rows))

        return run

    def seated(k: int):
        def run(key, messages, answers):
            return asked(sweep(key[0].as_py(), bucket(messages), answers.select(["owner", "answer", "carry"]).to_pylist(), k))

        return run

    def tell(key, messages, answers):
        rows = parts_of_scores(bucket(messages), messages.column("rows").to_pylist(), messages.column("table").to_pylist(), answers.select(["owner", "answer", "carry"]).to_pylist())
        trimmed()
        return _table(rows, ("run", "part", "table", "train_tokens"), (pa.int64(), pa.binary(), pa.binary(), pa.int64()))

    def gather(key, messages):
        return gathered(messages.to_pylist())

    sent = plain.mapInArrow(send, "bucket int, pairs binary, rows binary, table binary").groupBy("bucket")
    answers = sent.applyInArrow(ask, _ASKED).groupBy("owner").applyInArrow(answer(0), _ANSWERED)
    for k in range(1, SWEEPS + 1):
        answers = sent.cogroup(answers.groupBy("bucket")).applyInArrow(seated(k), _ASKED).groupBy("owner").applyInArrow(answer(k), _ANSWERED)
    told = sent.cogroup(answers.groupBy("bucket")).applyInArrow(tell, "run long, part binary, table binary, train_tokens long")
    scored = told.groupBy("run").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
