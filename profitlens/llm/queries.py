"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from profitlens.llm import bpe, chat_format, class_lm, decontaminate, html_extract, jaccard_join, line_dedup, quality_knn, quality_rules, source_divergence, suffix_dedup, token_align, token_file
from profitlens.llm.common import crc_mod, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = quality_knn.classify(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keys WHERE length(k) >= 10 GROUP BY k),
marked AS (
    SELECT keys.*, coalesce(doc_id > first_doc, false) AS gone
    FROM keys LEFT JOIN firsts ON keys.k = firsts.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents under the vocabulary file at ``path``."""
    return bpe.digests(docs, bpe.vocabulary(docs.sparkSession, path))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_tool_calls(table(spark, sf_dir, "conversations"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked documents with the item of each leak."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("leaked").select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
    SELECT lang, source, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM docs),
kept AS (
    SELECT lang, term, count(*)::HUGEINT AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (
    SELECT words.lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term)
    GROUP BY words.lang, source, term),
totals AS (
    SELECT groups.lang, groups.source, coalesce(sum(c), 0)::HUGEINT AS n
    FROM groups LEFT JOIN held USING (lang, source) GROUP BY groups.lang, groups.source),
grid AS (
    SELECT g.lang, g.source, k.term, k.in_lang, coalesce(h.c, 0) AS c,
           1 + (1000000000 * (coalesce(h.c, 0) + 1)) // (t.n + l.v) AS p,
           1 + (1000000000 * (k.in_lang + 1)) // (l.n + l.v) AS q
    FROM groups g JOIN totals t USING (lang, source) JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
    LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM grid x JOIN grid y USING (lang, term)
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = token_file.vocabulary(spark, vocabulary_path("word_bpe_49k.json"))
    return token_file.read(token_file.write(table(spark, sf_dir, "documents"), source, end=1))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = token_align.vocabularies(spark, vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    return token_align.align(table(spark, sf_dir, "documents"), source)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_bpe": op5_bpe,
    "op6_chat_format": op6_chat_format,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_file": op12_token_file,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_source_divergence": OP11_SQL}
