"""Language ID by Bayesian evidence fusion.

For each page the log-probabilities of its text under character trigram models are added to those of
three other signs: the language that its markup declares, the language that its address suffix or
path names, and the prior of its host. Host priors come from grouped aggregation: the text's own
verdicts are counted for each host, for each registered domain and over all, and each level is
smoothed by the one above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import Scratch, col, released, sliced, small_batches, store

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 14
#: The models are learnt from at most so many documents of each language, those with the least hashed
#: ids among the texts of at most so many bytes (longer ones are left out before the sample is drawn).
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 100_000
#: More languages than this are taken for dirty data, which is an error.
MOST_LANGUAGES = 500
#: Trust in a declared language, and in one that the address names: constants, so that what comes out
#: is a score between 0 and 1 and no calibrated probability.
DECLARED, ADDRESS = 0.9, 0.9
#: Pages of the level above that a host's own counts are mixed with.
STRENGTH = 20.0
#: A text's evidence counts as that of so many trigrams at most, as trigrams are not independent.
TEXT_WEIGHT = 60.0
#: Parts that the pages of a host are dealt out to.
SALTS = 16

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint32)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram, in lower case A-Z."""
    b = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(18)


def visible(html: Column) -> Column:
    """The text of a page's article, or of its body: no scripts, styles, comments, menus or tags."""
    body = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style|nav|footer|header|aside|noscript)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)", " ")
    article = F.regexp_extract(body, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    text = F.regexp_replace(F.regexp_replace(F.when(F.trim(article) != "", article).otherwise(body), r"(?s)<[^>]*>", " "), r"&[#\w]{1,10};", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signs(pages: DataFrame, languages: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, domain, declared and addressed (null if not one of ``languages``), text."""
    url, html = F.coalesce(col(url_col).cast("string"), F.lit("")), col(html_col)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    known = lambda c: F.when(c.isin(languages), c)
    declared = F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#_-]|$)", 1))
    return pages.select(col(id_col).cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), known(declared).alias("declared"), F.coalesce(known(suffix), known(path)).alias("addressed"), visible(html).alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and log-probabilities of the buckets in each.

    Rows without language or id are left out, a null text is empty, an id that is repeated counts all
    its rows. Languages tie by name. A table without languages gives none, and no model.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), col(lang_col).cast("string").alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).filter("lang is not null and id is not null")
    rows = rows.filter(F.octet_length("text") <= SAMPLE_BYTES)
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS))
    if not languages:
        return languages, counts
    # at most SAMPLE_DOCS ids of each language, so this side is bounded
    ids = rows.select("id", "lang").distinct()
    sample = [ids.filter(F.col("lang") == x).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS) for x in languages]
    every = sample[0]
    for x in sample[1:]:
        every = every.unionAll(x)
    texts = rows.join(F.broadcast(every), ["id", "lang"]).select("lang", F.col("text").cast("binary").alias("text"))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[lang] = n.get(lang, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in n.values()], pa.binary())], names=["lang", "n"])

    for lang, n in texts.mapInArrow(count, "lang string, n binary").toLocalIterator():
        counts[languages.index(lang)] += np.frombuffer(bytes(n), np.int64)
    return languages, np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)


def likelihoods(signed: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``signed`` with ``text_logs``, an array of log-likelihoods, instead of the text."""
    table = np.ascontiguousarray(model.T)
    fields = [f for f in signed.schema.fields if f.name != "text"]
    at = signed.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, at):
                logs = []
                for t in some.column(at).cast(pa.binary()).to_pylist():
                    if not t:
                        logs.append([0.0] * len(languages))
                        continue
                    of = trigrams(t)
                    logs.append((table[of].mean(axis=0) * min(len(of), TEXT_WEIGHT)).tolist())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(some.columns) if i != at), pa.array(logs, pa.list_(pa.float64()))], names=[*(f.name for f in fields), "text_logs"])

    return signed.select(signed.columns).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text_logs array<double>")


def _evidence(languages: list[str], logs: Column, declared: Column, addressed: Column) -> Column:
    """Log of text, markup and address evidence for each language."""
    n = len(languages)
    sure = lambda c, lang, p: F.when(c.isNull(), 0.0).when(c == lang, math.log(p)).otherwise(math.log((1 - p) / max(n - 1, 1)))
    return F.array(*[F.get(logs, F.lit(i)) + sure(declared, lang, DECLARED) + sure(addressed, lang, ADDRESS) for i, lang in enumerate(languages)])


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    shares = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda a, y: a + y))


def identify(pages: DataFrame, languages: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, lang, confidence and the probability of each language (``p_<language>``).

    A page without text is told by the other signs; one without any by its host's prior. Null ids,
    addresses and pages count as empty, ties go to the language that comes first by name, repeated
    rows are told each for itself and other columns are not read. An empty table gives no rows, and
    without languages no page has one. Texts are read once; their evidence is stored.

    The counts behind the priors are aggregated on the map side, and a host joins its one row of
    counts: Spark broadcasts them while they are few, and beyond that pages are dealt out by host and
    by ``SALTS`` parts of it, so that no host needs a task of its own.
    """
    small_batches(pages)
    n = len(languages)
    told = likelihoods(signs(pages, languages, id_col, url_col, html_col), languages, model)
    if not n:
        return told.select("page_id", "host", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    with Scratch(pages.sparkSession) as scratch:
        told = told.select("page_id", "host", "domain", _evidence(languages, F.col("text_logs"), F.col("declared"), F.col("addressed")).alias("evidence"))
        told = scratch.store(told.withColumn("salt", (F.rand(7) * SALTS).cast("int")))
        soft = told.withColumn("soft", _posterior(F.col("evidence")))
        hosts = scratch.store(soft.groupBy("host", "domain").agg(*[F.sum(F.get("soft", F.lit(i))).alias(f"n{i}") for i in range(n)]))
        domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)])
        whole = [float(x or 0) for x in hosts.agg(*[F.sum(f"n{i}") for i in range(n)]).first()]
        total = sum(whole)
        base = [(x + 1.0) / (total + n) for x in whole]
        add = lambda names: sum((F.col(c) for c in names[1:]), F.col(names[0]))
        d_all = add([f"d{i}" for i in range(n)])
        domains = domains.select("domain", *[((F.col(f"d{i}") + STRENGTH * base[i]) / (d_all + STRENGTH)).alias(f"q{i}") for i in range(n)])
        n_all = add([f"n{i}" for i in range(n)])
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        priors = hosts.join(domains, "domain").select("host", F.array(*[F.ln((F.col(f"n{i}") + STRENGTH * F.col(f"q{i}")) / (n_all + STRENGTH)) for i in range(n)]).alias("prior"), parts)
        fused = told.join(priors, ["host", "salt"]).withColumn("p", _posterior(F.array(*[F.get("evidence", F.lit(i)) + F.get("prior", F.lit(i)) for i in range(n)])))
        best = F.array_max("p")
        lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position("p", best).cast("int"))
        return store(fused.select("page_id", "host", lang.alias("lang"), F.round(best, 6).alias("confidence"), *[F.round(F.get("p", F.lit(i)), 6).alias(f"p_{x}") for i, x in enumerate(languages)]))
