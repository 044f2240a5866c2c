"""Operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeated
rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridra.llm import byte_bpe, chat, exact_dedup, language, lm, near_dedup, packing, quality, substring_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row int, c string, __spans int"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.8)) % vocabulary}" + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def corpus():
    base = [prose(i, 40 + 17 * i) for i in range(24)]
    texts = [*base, None, "", " \n\t ", "One two", "one  TWO", *base[:5], base[3] + " tail", base[9].replace("w1 ", "w2 ", 1), prose(99, 6000), "é漢字  x" * 300]
    passage = prose(7777, 60, 10_000)
    texts += [f"{prose(200 + i, 50)} {passage} {prose(300 + i, 50)}" for i in range(6)]
    texts += [" ".join(x if j % 97 else "edit" for j, x in enumerate(base[20].split(), k)) for k in range(8)]
    return [(i, t, "en", f"s{i % 3}", 0 if t is None else len(t), True, 1, "x", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, FIELDS).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_golomb_code():
    r = np.random.default_rng(1)
    for gaps in ([0], [5, 0, 0, 1 << 40], r.integers(0, 1000, 300), r.geometric(1e-15, 50)):
        gaps = np.array(gaps, np.uint64)
        k, unary, rest = exact_dedup.golomb_encode(gaps)
        assert (exact_dedup.golomb_decode(k, unary, rest, len(gaps)) == gaps).all()


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    for bits in (1 << 20, 64):  # with few slots all rows are suspects
        got = {r.doc_id: r for r in exact_dedup.decisions(docs, bitmap_bits=bits).collect()}
        assert len(got) == len(rows)
        for i, t, *_ in rows:
            g, r = groups[t or ""], got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), sha((t or "").encode()))
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_lm_scores(docs, rows, spark):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in lm.score(docs, train).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in rows}
    learnt = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in learnt for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, words in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) and r.score < 0
    held = [i for i in tokens if i not in learnt]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    # frequent contexts that are split into floors, and one bucket or many, change nothing about normalisation
    words = sorted(w.decode() for w in c if w and c[w])
    probes = spark.createDataFrame([(10_000 + i, w) for i, w in enumerate([*words, "", "unseen-word"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").withColumn("train", train).unionByName(probes.withColumn("train", F.lit(False)))
    scored = {r.doc_id: r.score for r in lm.score(both, F.col("train")).filter("doc_id >= 10000").collect()}
    first = sum(10 ** scored[10_000 + i] for i in range(len(words)))
    assert 0 < first <= 1.0 + 1e-9  # the sum over all texts of one word is a part of all probability


def log_stirling(d, n):
    """Log of the generalised Stirling numbers: [c, t] for c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        for t in range(1, c + 2):
            stay = out[c, t] + math.log(c - d * t) if t <= c else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def test_stirling_numbers_sum_to_rising_factorials():
    table, d, theta = log_stirling(0.3, 12), 0.3, 2.0
    for n in range(1, 13):
        total = sum(math.exp(table[n, t]) * math.prod(theta + d * k for k in range(t)) for t in range(1, n + 1))
        assert total == pytest.approx(math.prod(theta + k for k in range(n)), rel=1e-9)


@pytest.mark.parametrize("c,others,theta,d,p", [(1, 0, 1.0, 0.5, 0.1), (2, 3, 1.0, 0.5, 0.2), (6, 4, 5.0, 0.6, 0.3), (15, 2, 50.0, 0.1, 0.4), (40, 5, 3.0, 0.4, 0.2), (200, 50, 5.0, 0.5, 0.1)])
def test_seating_follows_its_distribution(c, others, theta, d, p):
    n, table = 20_000, log_stirling(d, c)
    got = lm.seat(np.full(n, c), np.full(n, others), theta, d, np.full(n, p), lm.mixed(np.arange(n, dtype=np.uint64) + np.uint64(7)), 3)
    logs = np.array([table[c, t] + sum(math.log(theta + d * (others + j)) for j in range(t)) + t * math.log(p) for t in range(1, c + 1)])
    exact = np.exp(logs - logs.max())
    exact /= exact.sum()
    mean = (exact * np.arange(1, c + 1)).sum()
    deviation = math.sqrt((exact * (np.arange(1, c + 1) - mean) ** 2).sum())
    assert got.mean() == pytest.approx(mean, abs=0.04 * mean) and got.std() == pytest.approx(deviation, abs=0.1 * deviation + 1e-9)
    assert got.min() >= 1 and got.max() <= c


def sampled(docs, buckets, owners, split, sweeps, samples):
    """The operator's rounds without Spark: each bucket with its answers to the last questions."""
    sent = lm._send(0, docs, buckets, split).to_pylist()
    held = {m["bucket"]: lm.Bucket([m["pairs"]], split, owners) for m in sent}

    def turned(rows, answer):
        by_owner, by_bucket = defaultdict(list), defaultdict(list)
        for owner, bucket, request, carry in sorted(rows):
            by_owner[owner].append({"bucket": bucket, "request": request, "carry": carry})
        for owner, some in by_owner.items():
            for bucket, o, reply, carry in answer(owner, some):
                by_bucket[bucket].append({"owner": o, "answer": reply, "carry": carry})
        return by_bucket

    answers = turned([r for n, b in held.items() for r in lm.first_questions(n, b)], lm.first_answers)
    for k in range(1, sweeps + 1):
        answers = turned([r for n, b in held.items() for r in lm.sweep(n, b, answers[n], k, sweeps, samples)], lambda o, m, k=k: lm.sweep_answers(o, m, k))
    return held, answers


def plain_sampler(tokens, d, theta, d_parent, sweeps, burn_in, seed=3):
    """Predictive probabilities by reseating one customer after another, with explicit tables."""
    r = random.Random(seed)
    v = len({w for _, w in tokens})
    tables, parent = defaultdict(list), defaultdict(list)
    below, above = Counter(), [0, 0]  # tables of each context; customers and tables of the parent
    sizes = Counter()

    def p_parent(w):
        n = sum(parent[w])
        return (n - d_parent * len(parent[w]) + (lm.PARENT_STRENGTH + d_parent * above[1]) / (v + 1)) / (lm.PARENT_STRENGTH + above[0])

    def pick(some, off, new):
        x = r.random() * (sum(some) - off * len(some) + new)
        for i, n in enumerate(some):
            x -= n - off
            if x < 0:
                return i
        return len(some)

    def enter(u, w):
        i = pick(tables[u, w], d, (theta + d * below[u]) * p_parent(w))
        sizes[u] += 1
        if i < len(tables[u, w]):
            tables[u, w][i] += 1
            return
        tables[u, w].append(1)
        below[u] += 1
        j = pick(parent[w], d_parent, (lm.PARENT_STRENGTH + d_parent * above[1]) / (v + 1))
        above[0] += 1
        if j < len(parent[w]):
            parent[w][j] += 1
        else:
            parent[w].append(1)
            above[1] += 1

    def drawn(some):
        x = r.random() * sum(some)
        return next(i for i, _ in enumerate(some) if sum(some[: i + 1]) > x)

    def leave(u, w):
        i = drawn(tables[u, w])
        tables[u, w][i] -= 1
        sizes[u] -= 1
        if tables[u, w][i]:
            return
        del tables[u, w][i]
        below[u] -= 1
        j = drawn(parent[w])
        parent[w][j] -= 1
        above[0] -= 1
        if not parent[w][j]:
            del parent[w][j]
            above[1] -= 1

    for u, w in tokens:
        enter(u, w)
    total, pairs = Counter(), set(tokens)
    for k in range(sweeps):
        for u, w in tokens:
            leave(u, w)
            enter(u, w)
        if k >= burn_in:
            for u, w in pairs:
                total[u, w] += (sum(tables[u, w]) - d * len(tables[u, w]) + (theta + d * below[u]) * p_parent(w)) / (theta + sizes[u])
    return {x: n / (sweeps - burn_in) for x, n in total.items()}


def test_sampler_agrees_with_a_plain_one():
    r = random.Random(8)
    texts = [" ".join(r.choice("aaaabbbccdef") for _ in range(r.randint(3, 14))) for _ in range(12)]
    docs = [(i, True, t.encode()) for i, t in enumerate(texts)]
    split = np.ones(1 << lm._BIN_BITS, np.int64)
    held, answers = sampled(docs, 2, 2, split, 160, 150)
    tokens = [x for t in texts for x in zip([None, *t.split()], [*t.split(), ""], strict=True)]
    name = {int(h): w for w, h in ((w.decode(), lm.cut([w]).numbered()[1][0]) for w in b"a b c d e f".split())} | {lm._END: "", lm._BEGIN: None}
    mine = {}
    for n, b in held.items():
        p, _, x = lm.predictive(b, answers[n])
        mine |= {(name[int(b.context[u])], name[int(b.words[w])]): q for u, w, q in zip(b.r, b.w, p, strict=True)}
    plain = plain_sampler(tokens, x.d, x.theta, x.d_parent, 1200, 200)
    assert mine.keys() == plain.keys()
    apart = [abs(math.log10(mine[k] / plain[k])) for k in plain]
    assert sum(apart) / len(apart) < 0.015 and max(apart) < 0.06


def test_scores_do_not_depend_on_buckets_or_splits():
    texts = [prose(i, 30 + i, 60) for i in range(30)]
    docs = [(i, i % 5 != 1, t.encode()) for i, t in enumerate(texts)]
    found = []
    for buckets, parts in ((1, 1), (5, 1), (7, 3)):
        held, answers = sampled(docs, buckets, 1, np.full(1 << lm._BIN_BITS, parts), lm.SWEEPS, lm.SAMPLES)
        one = {}
        for n, b in held.items():
            p, base, _ = lm.predictive(b, answers[n])
            one |= {(int(b.context[u]), int(b.words[w])): (q, base[w]) for u, w, q in zip(b.r, b.w, p, strict=True)}
        found.append(one)
    for one in found[1:]:
        assert one.keys() == found[0].keys() and all(one[k] == pytest.approx(found[0][k], rel=1e-9) for k in one)


def test_lm_scores_are_the_same_under_other_partition_settings(docs, spark, monkeypatch):
    for name, value in (("BUCKET_TOKENS", 3000), ("OWNER_TOKENS", 9000), ("FLUSH_TOKENS", 2000)):
        monkeypatch.setattr(lm, name, value)
    train, found = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, df in (("3", docs), ("11", docs.repartition(2))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(df, train).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-6) for k in found[0])


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(5)
    bad = ["scoundrel", "nitwit", "blockhead", "dunderhead", "numbskull"]
    rows = []
    for i in range(500):
        words = prose(5000 + i, r.randint(20, 300), 3000).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0)], "doc_id long, text string, toxic int")
    labels = df.filter("doc_id < 350").select("doc_id", "toxic")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 502
    held = [(got[i], y) for i, _, y in rows if i >= 350]
    caught = [s >= toxicity.THRESHOLD for s, y in held if y]
    wrong = [s >= toxicity.THRESHOLD for s, y in held if not y]
    assert sum(caught) / len(caught) >= 0.9 and sum(wrong) / len(wrong) <= 0.05
    assert toxicity.clean(df, model).count() == sum(s < toxicity.THRESHOLD for s in got.values())
    assert toxicity.train(df, labels.limit(0)).scores([b"any text"], []).tolist() == [0.0]


def test_byte_bpe(docs, rows):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, file, public_tokenizers.PATTERN, chunk_chars=500)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, file, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and bytes(got[i].bytes) == (t or "").encode() and got[i].ids_text == " ".join(map(str, ids))


@pytest.mark.parametrize("size", [20, 33])
def test_chunks_meet_in_odd_texts(monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "OVERLAP_CHARS", 16)
    coder = byte_bpe.Coder.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(3)
    for text in ["x" * 300, " " * 300, "a b" * 90, "\n\n \n" * 40, "漢字" * 200, "\t\n" * 200, "'ll" * 70, *("".join(r.choice("ab é\n\t  12's\x1c\x85\xa0　ß字!?#'ll") for _ in range(n)) for n in range(1, 300, 2))]:
        assert coder.encode(text, size) == coder.encode(text, 10_000)


def test_text_without_spaces_is_not_sent_much_longer_than_it_is():
    text = "漢" * 400_000
    assert sum(len(chunk) for _, chunk, _ in byte_bpe.chunks(text, byte_bpe.CHUNK_CHARS)) < 1.05 * len(text)


def test_near_dedup(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in near_dedup.decisions(docs, shingle_words=4).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert len({find(i) for i in sets}) < len(sets) - 8


def test_pairs_whose_digests_agree_by_chance_are_not_skipped(spark):
    values = np.random.default_rng(3).integers(0, 1 << 32, (4, near_dedup.COORDINATES), dtype=np.uint64).astype("<u4")
    values[1] = values[0]
    values[1, 0] ^= 1 << 20  # another value, of the same low bits
    values[2, 0], values[3, 0] = values[0, 0], values[1, 0]  # the first coordinate's lists hold others too
    rows = [(i, 100, bytearray(v.tobytes()), bytearray(near_dedup.PARITY_BITS // 8)) for i, v in enumerate(values)]
    classes = spark.createDataFrame(rows, "class long, n long, signature binary, parity binary")
    mixed = near_dedup._mixed(near_dedup._lists(classes, near_dedup.MATCHES), spark.createDataFrame([], "a long, b long"))
    assert near_dedup._pairs(mixed, near_dedup.MATCHES, near_dedup.SIMILARITY).collect() == [(1, 0)]


def test_quality_rules(docs, rows):
    got = {r.doc_id: r for r in quality.rate(docs).collect()}
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        n = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = set()
        for j in range(len(words) - 2):
            if n[words[j], words[j + 1], words[j + 2]] > 1:
                cover |= {j, j + 1, j + 2}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(words), len(cover), len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words)) and (not got[i].base_failed or not got[i].kept)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    line = "subscribe to our letter 2024"
    rows = [(i, f"{prose(i, 80, 9000)}\n{line}", "a") for i in range(20)] + [(50 + i, "\n".join([line] * 30) + f"\nx{i} y{i}", "a") for i in range(3)] + [(90, f"{prose(90, 80, 9000)}\n{line}", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.words_removed, r.kept) for r in quality.rate(df, limit_docs=10, limit_share=0.1).collect()}
    assert got[3] == (5, True) and got[90] == (0, True) and got[51][1] is False
    texts = {r.doc_id: r.text for r in quality.clean(df, limit_docs=10, limit_share=0.1).collect()}
    assert line not in texts[3] and line in texts[90] and 51 not in texts


def test_language(spark):
    words = {"en": "the and of that with for", "fr": "le la les et que pour", "de": "der die und nicht mit von"}
    r = random.Random(1)
    text = lambda x, n: " ".join(r.choice(words[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(i, text(x, 60), x) for i, x in enumerate(["en", "fr", "de"] * 20)], "doc_id long, text string, lang string")
    model = language.train(docs)
    page = lambda x, n, tag="": f'<html{tag}><script>var the="and";</script><body><nav>{text("en", 20)}</nav><article>{text(x, n)}</article></body></html>'
    rows = [(i, f"https://h{x}.example.org/p/{i}", page(x, 40), x) for i, x in enumerate(["en", "fr", "de"] * 15)]
    rows += [(100, "https://hde.example.org/x", "<html></html>", "de"), (101, "https://new.site/fr/1", '<html lang="fr"><body></body></html>', "fr"), (102, None, None, None)]
    got = {x.page_id: x for x in language.identify(spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string"), *model).collect()}
    assert len(got) == len(rows) and all(got[i].lang == x for i, _, _, x in rows if x)
    assert got[0].p_en + got[0].p_fr + got[0].p_de == pytest.approx(1, abs=1e-5)


def test_chat(spark):
    turns = [(0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad"), (1, 3, "user", None), (2, 5, None, "u2"), (2, 6, "assistant", "a2"), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.neighbours(chat.conversations(df))).collect()}
    t = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {0, 1, 2}
    a = got[0]
    assert (a.prompt, a.chosen, a.rejected) == (t("system", "s") + t("user", "u"), t("assistant", "good"), t("assistant", "bad") + t("user", ""))
    assert [a.chosen[m.start : m.start + m.length] for m in a.chosen_mask if m.trained] == ["good<|im_end|>\n"]
    assert sum(m.length for m in a.rejected_mask) == len(a.rejected)
    assert (got[1].rejected_id, got[1].prompt, got[1].chosen, got[1].rejected) == (None, t("", "u2"), t("assistant", "a2"), None)
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")


def test_packing(docs, rows, spark):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    odd = ["hello <|endoftext|> world", "a<|startoftext|>b. <|ENDOFTEXT|> Été", "<|x É|>", "don't stop. 3.14, U.S.A.! e\u0301 \u0308a"]
    rows = [*rows, *((1000 + i, t) for i, t in enumerate(odd))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows[-len(odd) :]], "doc_id long, text string"))
    got = packing.pack(docs, file).toPandas()
    for i, t, *_ in rows:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() == g.sequence_length.iloc[0] <= 4096
        assert g.sequence_length.iloc[0].bit_count() == 1  # no padding
    assert got.groupby("step_group").length.sum().max() <= packing.STEP_TOKENS


def brute_force_windows(rows, k):
    first = {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), (i, j))
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {j + x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] != (i, j) for x in range(k)}
        out[i] = len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.mark.parametrize("k,flush", [(20, 500_000), (5, 300), (1, 1000)])
def test_substring_dedup(docs, rows, k, flush, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", flush)
    got = substring_dedup.remove(docs, k=k, counts=("words", "removed"))
    assert got.columns == [*docs.columns, "words", "removed"]
    expected = brute_force_windows([r[:2] for r in rows], k)
    assert {r.doc_id: (r.words, r.removed, b" ".join((r.text or "").encode().split())) for r in got.collect()} == expected


def test_super_kmers_of_more_words_than_positions_fit(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_AT_BITS", 8)
    r, k = np.random.default_rng(9), 20
    hashes, some = r.integers(1, 1 << 63, 300, dtype=np.uint64), r.integers(0, 300, 700)
    ids, lengths = np.concatenate([some, r.integers(0, 300, 333), some]), np.array([700, 5, 0, 328, 700])
    ends = np.cumsum(lengths)
    keys = {}
    for first, count, key in zip(*(x.tolist() for x in substring_dedup.super_kmers(ids, lengths, hashes, k)), strict=True):
        for at in range(first, first + count):
            assert at not in keys
            keys[at] = key
    assert set(keys) == {at for n, e in zip(lengths.tolist(), ends.tolist(), strict=True) for at in range(e - n, e - k + 1)}
    assert all(keys[at] == keys[at + 1033] for at in range(700 - k + 1))


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    ranks, words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    for out in (exact_dedup.decisions(none), exact_dedup.keep(none), lm.score(none, F.lit(True)), byte_bpe.encode(none, ranks, public_tokenizers.PATTERN), near_dedup.decisions(none), near_dedup.keep(none), quality.rate(none), packing.pack(none, words), substring_dedup.remove(none)):
        assert out.count() == 0


def test_rows_repeated_and_without_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.decisions(df).collect()) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert exact_dedup.keep(df).count() == 3
    near = near_dedup.decisions(df).collect()
    assert len(near) == 5 and all(r.component_id == (1 if r.doc_id else None) for r in near)
    assert lm.score(df, F.lit(True)).count() == 5 and substring_dedup.remove(df, k=3).count() == 5
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).count() >= 5 and quality.rate(df.withColumn("source", F.lit(None).cast("string"))).count() == 5


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    texts = {t or "" for _, t, *_ in rows}
    assert counts[0] == len(rows) and counts[1] == len(texts) and counts[2] < counts[1] and counts[3] == counts[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()
