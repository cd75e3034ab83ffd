"""The registered queries of this package, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    alignment,
    chat,
    exact,
    jaccard,
    lines,
    minmax,
    mixing,
    packing,
    quality_model,
    rules,
    spelling,
    substring,
    token_files,
)
from tidemark.llm.storage import doc_id, documents, saved
from tidemark.session import workspace

#: The pattern of a word, for SQL.
WORD = r"[^\x20\x09-\x0D]+"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), host="source")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select(doc_id(), "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_lines(documents(spark, sf_dir)).drop("kept_text")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "token-files")
    token_files.write(documents(spark, sf_dir), folder, tokenizer_path(), end=2)
    return token_files.read(spark, folder)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.learn(docs, labels.select("doc_id", labels["quality"].alias("label")))
    return quality_model.score(docs, model)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    return chat.summary(saved(chat.examples(rows.unionByName(own)), "chat"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), end=1)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align_documents(documents(spark, sf_dir), a, b)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(documents(spark, sf_dir))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_files": op6_token_files,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minmax_dedup": op13_minmax_dedup,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": rf"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
        ), spans AS (
            SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS passage
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts)
        ), later AS (
            SELECT doc_id, i FROM spans
            QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
        ), kept AS (
            SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
            FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_source_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, text,
                coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
                    / 4503599627370496.0 AS draw
            FROM documents
        ), keyed AS (
            SELECT doc_id, source, size,
                -ln(draw::DOUBLE) / CASE WHEN size > 0 THEN size / (size + coalesce(
                    length(text) - length(translate(text, '#*$%&|<>', '')), 0)) ELSE 1.0 END AS key
            FROM sized
        ), sources AS (
            SELECT source, sum(size) AS source_size, 3 * sum(size) AS most,
                1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM keyed GROUP BY source
        ), shares AS (
            -- The share of a unit of weight if the sources with a smaller most / weight stop.
            -- It rises while a source that stops is below it, and falls from there on.
            SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS share
            FROM sources
            WINDOW earlier AS (
                ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            )
        ), goals AS (
            SELECT source, source_size, least(
                (SELECT max(share) FROM shares) * weight, most::DOUBLE) AS target
            FROM shares
        ), placed AS (
            SELECT doc_id, size, source_size, target,
                CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
                coalesce(sum(size) OVER (
                    PARTITION BY keyed.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
                ), 0) AS before
            FROM keyed JOIN goals ON keyed.source IS NOT DISTINCT FROM goals.source
        )
        SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (epochs + CASE
            WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM placed
    """,
    "op4_quality_rules": rf"""
        WITH texts AS (
            SELECT doc_id, source, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
        ), spans AS (
            SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS passage
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)
        ), again AS (
            SELECT doc_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, passage) > 1
        ), repeats AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again)
            GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
        ), dups AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
            WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
        ), measures AS (
            SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
            FROM texts LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
        ), judged AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures
        ), hosts AS (
            SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS failed FROM judged
            WHERE source IS NOT NULL GROUP BY source
        ), moments AS (
            SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts
        ), prior AS (
            SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 0), 1e6) ELSE 1e6 END AS strength
            FROM moments
        ), rejected AS (
            SELECT source FROM hosts, prior WHERE (failed + m * strength) / (n + strength) > 0.5
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
        FROM judged
    """,
    "op8_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), sized AS (
            SELECT *, 23 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
                    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_last,
                row_number() OVER ordered AS i
            FROM turns WINDOW ordered AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), placed AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE WHEN role = 'assistant' OR from_last = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id
    """,
}
