"""The numbered queries: each applies its operator to whole tables and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import bpe, conversations, language, lm, oracle, packing, passages, pii, quality, repeats, simhash, spelling, toxicity
from textveil.llm.common import crc_mod, documents
from textveil.llm.exact_dedup import exact_groups
from textveil.sources import tables


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def pii_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of pii.find, and all spans as text."""
    listed = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.KINDS]
    digest = F.sha2(F.expr(listed.format("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, F.expr(listed.format("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the base spans; spans lists these and the disguised ones. Null texts have none."""
    return pii_digests(pii.find(documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out, predicted = (crc_mod("doc_id", 5) == 0).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", predicted)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, digests=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target: labelled rows of quality 1."""
    docs = documents(spark, sf_dir)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality.verdicts(docs, trusted).drop("score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = (crc_mod("doc_id", 10) == 0).alias("held_out")
    return lm.score(docs, lm.split(docs)[0]).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.expr("aggregate(spans, 0L, (sum, x) -> sum + x.end - x.start)").alias("n_removed")
    found = repeats.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of documents with smaller ids. Nulls as in passages.remove_passages."""
    removed = F.expr("aggregate(spans, 0L, (sum, x) -> sum + x.end - x.start)").alias("n_removed")
    return passages.remove_passages(documents(spark, sf_dir)).select("doc_id", "n_words", removed, F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the damaged documents with its form and root. Null texts have no words; ties as in spelling.variants."""
    return spelling.variants(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the contract's damage: its faults, and the cheapest repair. Nulls and ties as in conversations.repair."""
    return conversations.repair(tables.read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_passages": op11_passages,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL = {
    "op6_quality": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), token AS (
            SELECT row, doc_id, i, ('0x' || left(md5(words[i]), 8))::BIGINT AS h, words[i : i + {quality.WINDOW - 1}] AS five, len(words) AS n
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d)
        ), again AS (
            SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS times FROM token WHERE i <= n - {quality.WINDOW - 1}) WHERE times > 1
        ), inside AS (
            SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, {quality.WINDOW}) AS r(k) GROUP BY row
        ), gram AS (
            SELECT row, doc_id, 1 AS size, h % {quality.CELLS} AS cell FROM token
            UNION ALL
            SELECT row, doc_id, 2, if(h = after, 0, (31 * h + after) % {quality.CELLS})
            FROM (SELECT row, doc_id, h, lead(h) OVER (PARTITION BY row ORDER BY i) AS after FROM token) WHERE after IS NOT NULL
        ), chosen AS (
            SELECT DISTINCT doc_id, md5(doc_id::VARCHAR) AS place FROM labels WHERE quality = 1 AND doc_id IS NOT NULL ORDER BY place, doc_id LIMIT {quality.TARGET_ROWS}
        ), count AS (
            SELECT size, cell, count(*) AS raw, count(chosen.doc_id) AS target FROM gram LEFT JOIN chosen USING (doc_id) GROUP BY size, cell
        ), weight AS (
            SELECT size, cell, ln((target + {quality.PRIOR}) / (sum(target) OVER w + {quality.PRIOR * quality.CELLS}))
                               - ln((raw + {quality.PRIOR}) / (sum(raw) OVER w + {quality.PRIOR * quality.CELLS})) AS weight
            FROM count WINDOW w AS (PARTITION BY size)
        ), score AS (
            SELECT row, min(mean) AS score FROM (SELECT row, size, avg(weight) AS mean FROM gram JOIN weight USING (size, cell) GROUP BY row, size) GROUP BY row
        ), base AS (
            SELECT row, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
            FROM d
        ), ruled AS (
            SELECT base.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score, 0) AS score,
                   n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed
            FROM base LEFT JOIN inside USING (row) LEFT JOIN score USING (row)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {quality.THRESHOLD} AS kept
        FROM ruled""",
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)""",
    "op10_suffix_dedup": rf"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n_bytes FROM documents
        ), win AS (
            SELECT doc_id, c + i AS p, substr(part, 2 * i + 1, {2 * repeats.WINDOW}) AS w
            FROM (SELECT doc_id, c, part, unnest(range(0, least(1000, n_bytes - {repeats.WINDOW - 1} - c))) AS i
                  FROM (SELECT doc_id, n_bytes, c, substr(x, 2 * c + 1, {2 * (1000 + repeats.WINDOW)}) AS part FROM (SELECT *, unnest(range(0, n_bytes - {repeats.WINDOW - 1}, 1000)) AS c FROM d WHERE n_bytes >= {repeats.WINDOW})))
        ), again AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
        ), step AS (
            SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again
        ), run AS (
            SELECT doc_id, min(p) AS s, max(p) + {repeats.WINDOW} AS e FROM (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {repeats.WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM step) GROUP BY doc_id, r
        ), gap AS (
            SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a FROM run
        ), kept AS (
            SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * a + 1, 2 * (s - a)), '' ORDER BY s) AS head FROM gap JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_passages": oracle.PASSAGES,
    "op12_spelling": oracle.SPELLING,
    "op13_conversations": oracle.CONVERSATIONS,
}
