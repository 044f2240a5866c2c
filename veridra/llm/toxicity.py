"""Toxicity by compression distance.

Zstandard dictionaries are trained in pairs of one size, one on windows of toxic text and one on as
many windows of ordinary text. A window's distance is the number of bytes by which the toxic
dictionary shortens it more than the ordinary one. A small dictionary holds only some of the prose of
its windows, by chance, which is noise; so each distance is the mean of several pairs,
trained on random parts.

Most windows of a toxic text are ordinary. Therefore there are rounds: the first is trained on all
windows, each later one only on the ``HARDEST`` share of each document's windows, by the distances so
far, of both classes alike. A round so learns what tells toxic windows from the ordinary ones that
look most like them. Every window goes through the first round, and the ``SEARCHED`` share of a
document's windows that this one finds most toxic through the others; distances are summed.

A document is scored by a logistic function of what its windows' distances are like (the largest, the
upper ones, the mean, and their log-likelihood ratio between the classes). It is fitted to distances
under dictionaries that were trained without the document, fold by fold, and corrected for the
classes' shares, so that scores are probabilities and one threshold holds.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import col, released, sliced, small_batches

WINDOW_WORDS = 6
#: Size of a dictionary, and of the segments it is made of.
DICTIONARY_BYTES, SEGMENT, MATCH = 8192, 24, 6
LEVEL = 3
#: Pairs of dictionaries in the first round, which sees all windows, and in each later one; the share of
#: the windows that each is trained on.
FIRST_PAIRS, PAIRS, PART, ROUNDS = 3, 4, 0.6, 5
HARDEST, SEARCHED = 0.05, 0.15
FOLDS = 3
#: A document is taken for toxic from this score on.
THRESHOLD = 0.3
#: The sample that the dictionaries and the fit are learnt from: labelled documents of each class, of
#: texts of at most so many bytes (longer ones are left out before the sample is drawn). So it is 80 MB
#: at most. Nothing else is bounded; every text is scored whole.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 10_000
#: Bytes of a text that are cut into windows at a time.
_BLOCK = 1 << 18
#: Windows that go through the dictionaries together, about.
_TOGETHER = 8192

_BREAKS = b" \t\n\v\f\r"
#: The one window of a text without words.
_NOTHING = b"  "


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in parts that end at white space."""
    at = 0
    while len(text) - at > _BLOCK:
        end = at + _BLOCK
        while end < len(text) and text[end] not in _BREAKS:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The windows of a text, lower-cased in A-Z, some at a time."""
    for block in _blocks(text):
        words = block.lower().split()
        if words:
            yield [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(data: bytes):
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _gains(some: list[bytes], pairs: list[tuple]) -> np.ndarray:
    out = np.zeros(len(some))
    for ordinary, toxic in pairs:
        out += np.fromiter(map(len, map(ordinary, some)), np.int64, len(some)) - np.fromiter(map(len, map(toxic, some)), np.int64, len(some))
    return out / len(pairs)


def _searched(d: np.ndarray) -> np.ndarray:
    """Which windows the later rounds look at, by the first round's distances, the farthest first."""
    return np.argsort(-d, kind="stable")[: max(3, int(np.ceil(len(d) * SEARCHED)))]


def distances(texts: list[bytes], rounds: list[list[tuple]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the first round's distance of each window, and the sums over all rounds of those
    that are searched; a text without words has one window of no distance.

    Windows of several texts go through a dictionary together, while it is in the processor's cache.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[list[bytes]] = []

    def told() -> None:
        every = [w for some in held for w in some]
        first = np.split(_gains(every, rounds[0]), np.cumsum([len(some) for some in held])[:-1])
        at = [_searched(d) for d in first]
        chosen = [some[i] for some, x in zip(held, at, strict=True) for i in x]
        more = sum((_gains(chosen, pairs) for pairs in rounds[1:]), np.zeros(len(chosen)))
        for d, x, later in zip(first, at, np.split(more, np.cumsum([len(x) for x in at])[:-1]), strict=True):
            out.append((d, d[x] + later))
        held.clear()

    n = 0
    for text in texts:
        some = [w for part in windows(text) for w in part] or [_NOTHING]
        held.append(some)
        n += len(some)
        if n >= _TOGETHER:
            told()
            n = 0
    if held:
        told()
    return out


@dataclass
class Model:
    #: Pairs (ordinary, toxic) of dictionaries of each round.
    rounds: list[list[tuple[bytes, bytes]]]
    #: Log-likelihood ratio of a searched window by its distance.
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_FEATURES + 1))
    #: The score of every text, where there is nothing to tell classes by.
    same: float | None = None

    def compressors(self) -> list[list[tuple]]:
        return [[(_compressor(a), _compressor(b)) for a, b in pairs] for pairs in self.rounds]

    def features(self, first: np.ndarray, searched: np.ndarray) -> np.ndarray:
        n, top = len(first), -np.sort(-searched)
        ratio = self.ratio[np.searchsorted(self.edges, searched, "right")]
        return np.array([top[0], top[:3].mean(), top[: max(1, n // 10)].mean(), top.mean(), first.mean(), ratio.sum(), ratio.mean(), np.log(n)])

    def scores(self, texts: list[bytes], compressors: list[list[tuple]]) -> np.ndarray:
        if self.same is not None or not texts:
            return np.full(len(texts), self.same or 0.0)
        x = (np.array([self.features(*d) for d in distances(texts, compressors)]) - self.mean) / self.scale
        return _logistic(self.weights[0] + x @ self.weights[1:])


_FEATURES = 8


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, the constant first: Newton's steps on a penalised likelihood,
    halved where they would not raise it."""
    x = np.c_[np.ones(len(x)), x]
    penalty = np.r_[1e-6, np.ones(x.shape[1] - 1)]
    value = lambda w: float((y * (x @ w) - np.logaddexp(0, x @ w)).sum() - (penalty * w * w).sum() / 2)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        while value(w + step) < value(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _trained(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=MATCH, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(dict.fromkeys(samples)) or b" " * 8)[-DICTIONARY_BYTES:].ljust(8)


def _round(toxic: list[list[bytes]], ordinary: list[list[bytes]], draw: random.Random, pairs: int) -> list[tuple[bytes, bytes]]:
    """Pairs (ordinary, toxic) trained on windows, given for each document."""
    t, o = ([w for some in x for w in some] for x in (toxic, ordinary))
    out = []
    for _ in range(pairs):
        n = max(1, int(min(len(t), len(o)) * PART)) if t and o else 0
        out.append((_trained(draw.sample(o, n)), _trained(draw.sample(t, n))))
    return out


def fit(rows: list[tuple[bytes, int]], weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """rows: text and label of the sample; weight: rows of the whole for each row of the sample, by
    class. Without any row of a class all scores are alike."""
    rows = sorted(set(rows))
    classes = [[t for t, y in rows if y == label] for label in (0, 1)]
    if not all(classes):
        return Model([], same=float(bool(classes[1])))
    draw = random.Random(17)
    for some in classes:
        draw.shuffle(some)
    cut = [[[w for part in windows(t) for w in part] or [_NOTHING] for t in some] for some in classes]
    folds = [np.arange(len(some)) % FOLDS for some in classes]
    first = [[np.zeros(0)] * len(some) for some in cut]
    at = [[np.zeros(0, np.int64)] * len(some) for some in cut]
    far = [[np.zeros(0)] * len(some) for some in cut]  # sums over rounds, of the windows ``at``
    chosen, rounds = cut, []
    for number in range(ROUNDS):
        many = PAIRS if number else FIRST_PAIRS
        for fold in range(FOLDS):
            apart = [[some[i] for i in np.flatnonzero(f != fold)] for some, f in zip(chosen, folds, strict=True)]
            held = [(_compressor(a), _compressor(b)) for a, b in _round(apart[1], apart[0], draw, many)]
            for label in (0, 1):
                mine = np.flatnonzero(folds[label] == fold).tolist()
                looked = [cut[label][i] if not number else [cut[label][i][j] for j in at[label][i]] for i in mine]
                if not mine:
                    continue
                for i, d in zip(mine, np.split(_gains([w for some in looked for w in some], held), np.cumsum([len(some) for some in looked])[:-1]), strict=True):
                    if number:
                        far[label][i] = far[label][i] + d
                    else:
                        first[label][i], at[label][i] = d, _searched(d)
                        far[label][i] = d[at[label][i]]
        rounds.append(_round(chosen[1], chosen[0], draw, many))
        hardest = lambda w, x, d: [w[x[j]] for j in np.argsort(-d, kind="stable")[: max(1, int(np.ceil(len(w) * HARDEST)))]]
        chosen = [[hardest(*y) for y in zip(cut[label], at[label], far[label], strict=True)] for label in (0, 1)]
    model = Model(rounds)
    each = [np.concatenate(x) for x in far]
    model.edges = np.unique(np.quantile(np.concatenate(each), [*np.linspace(0, 1, 25)[1:-1], 0.98, 0.99, 0.995]))
    counts = [np.bincount(np.searchsorted(model.edges, d, "right"), minlength=len(model.edges) + 1) + 5.0 for d in each]
    model.ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.array([model.features(a, b) for label in (0, 1) for a, b in zip(first[label], far[label], strict=True)])
    y = np.repeat([0, 1], [len(some) for some in far])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _fitted((x - model.mean) / model.scale, y)
    model.weights[0] += np.log(weight[1] / weight[0])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``SAMPLE_DOCS`` labelled documents of each class, those with the least
    hashed ids among the texts of at most ``SAMPLE_BYTES``.

    Null labels and ids are left out, null texts are empty. Labels other than 0 and 1 are not read;
    rows repeated count once, and a document with both labels is in both classes. Without documents
    or labels the model gives all texts the score 0.
    """
    known = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").distinct()
    texts = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    short = texts.filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows, weight = [], [1.0, 1.0]
    among = short.select("id").distinct().join(known, "id")
    total = {r[0]: r[1] for r in among.groupBy("label").count().collect()}
    for label in (0, 1):
        # at most SAMPLE_DOCS ids, so this side is bounded
        sample = among.filter(F.col("label") == label).select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
        got = short.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").cast("binary").alias("text")).select("text").collect()
        rows += [(bytes(t), label) for (t,) in got]
        weight[label] = max(1.0, total.get(label, 0) / SAMPLE_DOCS)
    return fit(rows, (weight[0], weight[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text.

    Null text is empty and gets the score of a text without windows. Null ids and repeated rows are
    scored each for itself; other columns are not read. An empty table gives no rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for some in sliced(batch, 1):
                got = model.scores([t or b"" for t in some.column(1).to_pylist()], compressors)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    small_batches(docs)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns.

    Null text is empty; null ids and repeated rows are judged each for itself, by the text alone.
    Columns may have any name and type. An empty table stays empty.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    small_batches(docs)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for some in sliced(batch, at):
                keep = model.scores([t or b"" for t in some.column(at).cast(pa.binary()).to_pylist()], compressors) < threshold
                yield pa.RecordBatch.from_arrays(some.filter(pa.array(keep, pa.bool_())).columns, names=schema.names)

    return docs.mapInArrow(run, schema)
