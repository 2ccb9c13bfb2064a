"""Queries over the columns of op2, op4 and op9 that SQL can say, each through its operator, with the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqweave.llm import fingerprints, licenses, pii


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's base finds in every document."""
    return licenses.scan(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and edited text of every document, as op4 makes them."""
    return fingerprints.fingerprints(_documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's base finds in every document, counted by kind."""
    return pii.find(_documents(spark, sf_dir), pii.Model()).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


QUERIES = {"license_base_columns": license_base_columns, "fingerprint_texts": fingerprint_texts, "personal_data_counts": personal_data_counts}
SQL = {
    "license_base_columns": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases(label, parts) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
found AS (SELECT doc_id, label, unnest(list_filter(range(0, len(words) - len(parts) + 1), lambda i: words[i + 1 : i + len(parts)] = parts)) AS place FROM w, phrases),
per AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM found GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN per ON per.doc_id = w.doc_id
""",
    "fingerprint_texts": """
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
  coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, n AS n_chars, sha256(substring(text, 1, n - n // 2) || substring(following, 1, n // 2)) AS edited_sha256 FROM o
""",
    "personal_data_counts": r"""
WITH m AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
    regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ips, regexp_extract_all(coalesce(text, ''), '[0-9](?:[\x20-]?[0-9])+') AS cards,
    regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') AS phones FROM documents),
d AS (SELECT doc_id, n_email, ips, list_transform(cards, lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS cards, list_transform(phones, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g'))) AS phones FROM m)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: p::HUGEINT > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(cards, lambda c: length(c) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN c[length(c) - i + 1]::INT
    WHEN c[length(c) - i + 1]::INT > 4 THEN c[length(c) - i + 1]::INT * 2 - 9 ELSE c[length(c) - i + 1]::INT * 2 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 9 AND 15))::BIGINT AS n_phone FROM d
""",
}
