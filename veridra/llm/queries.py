"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.llm import byte_bpe, chat, exact_dedup, language, lm, near_dedup, packing, quality, substring_dedup, toxicity
from veridra.llm.common import crc_mod, documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scored = lm.score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decoder(ranks, public_tokenizers.PATTERN)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        from hashlib import sha256

        doc_id, ids, made, shown = decoded(batch).columns
        sums = [pa.array([sha256(x).hexdigest() for x in c.cast(pa.binary()).to_pylist()], pa.string()) for c in (shown, made)]
        return pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) // 4 for x in ids.to_pylist()], pa.int64()), *sums], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return byte_bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, then=digest, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decisions(documents(spark, sf_dir), shingle_words=4)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), *language.train(documents(spark, sf_dir)))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_preferences(chat.neighbours(chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    trained = lambda mask: F.coalesce(F.aggregate(F.filter(mask, lambda m: m["trained"]), F.lit(0), lambda n, m: n + m["length"]), F.lit(0)).cast("long")
    return formatted.select("pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected", trained(F.col("chosen_mask")).alias("chosen_trained_chars"), trained(F.col("rejected_mask")).alias("rejected_trained_chars"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove(documents(spark, sf_dir).select("doc_id", "text"), counts=("n_words", "n_removed", "kept_sha256"))
    return cut.drop("text")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_lm_scoring, op3_toxicity, op4_byte_bpe, op5_near_dedup, op6_quality_rules, op7_language_id, op8_chat_formatting, op9_packing, op10_substring_dedup)}

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op8_chat_formatting": """
        WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        p AS (SELECT conv_id // 2 AS pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id,
                     any_value(l) FILTER (conv_id % 2 = 0) AS a, any_value(l) FILTER (conv_id % 2 = 1) AS b FROM t GROUP BY 1),
        q AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL
                 THEN coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), least(len(a), len(b)) + 1) - 1
                 ELSE coalesce(nullif(list_position(list_transform(coalesce(a, b), lambda x: x.role), 'assistant'), 0) - 1, len(coalesce(a, b))) END AS n FROM p)
        SELECT pair_id, chosen_id, rejected_id, CAST(n AS BIGINT) AS prompt_turns,
               array_to_string(list_transform(coalesce(a, b)[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS prompt,
               array_to_string(list_transform(a[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chosen,
               array_to_string(list_transform(b[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS rejected,
               CAST(coalesce(list_sum(list_transform(list_filter(a[n + 1:], lambda x: x.role = 'assistant'), lambda x: length(x.text) + 11)), 0) AS BIGINT) AS chosen_trained_chars,
               CAST(coalesce(list_sum(list_transform(list_filter(b[n + 1:], lambda x: x.role = 'assistant'), lambda x: length(x.text) + 11)), 0) AS BIGINT) AS rejected_trained_chars
        FROM q""",
    "op6_quality_rules": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS window_words FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
        again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, window_words) > 1),
        cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
        lines AS (SELECT DISTINCT host, t, trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line, x
                  FROM (SELECT host, t, unnest(ls) AS x FROM w)),
        frequent AS (SELECT host, line FROM lines JOIN (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host) USING (host) GROUP BY host, line HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.02 * max(docs)),
        removed AS (SELECT host, t, sum(len(list_filter(string_split(line, ' '), lambda y: y <> '')) * len(list_filter(string_split(t, chr(10)), lambda z: z = x))) AS n FROM lines JOIN frequent USING (host, line) GROUP BY host, t),
        m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                     coalesce(cover.n, 0) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS words_removed
              FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN removed USING (host, t))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= 0.3 * n_words AS kept FROM m""",
}
