"""Validation, cleaning and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions import expressions as X
from seqweave.operators import clean, splits
from seqweave.plans.registry import query
from seqweave.sources.adapters import DOCUMENT_SEQUENCES, EVENT_RESIDUES, EVENT_SEQUENCES, document_sequences, event_residues, event_sequences, table

ES = f"WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}"
DS = f"WITH {DOCUMENT_SEQUENCES}"
IDS = """ids AS (SELECT DISTINCT doc_id::VARCHAR AS protein_id FROM documents), err AS (SELECT DISTINCT doc_id::VARCHAR AS protein_id FROM labels WHERE toxic = 1),
hold AS (SELECT DISTINCT item_id::VARCHAR AS protein_id FROM benchmark), elig AS (SELECT protein_id FROM ids EXCEPT SELECT protein_id FROM err EXCEPT SELECT protein_id FROM hold)"""


def _ids(spark, sf):
    name = lambda t, c: table(spark, sf, t).select(F.col(c).cast("string").alias("protein_id"))
    error = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("protein_id"))
    return name("documents", "doc_id"), error, name("benchmark", "item_id")


@query("p1_normalize", f"{DS} SELECT protein_id, sha256(translate(sequence, 'UZOB', 'XXXX')) AS digest FROM ds")
def p1(spark, sf):
    return document_sequences(spark, sf).select("protein_id", F.sha2(X.normalize(F.col("sequence")), 256).alias("digest"))


@query("p2_sanitize", f"{DS} SELECT protein_id, sha256(translate(sequence, 'UZOBJ', 'XXXXX')) AS digest FROM ds")
def p2(spark, sf):
    return document_sequences(spark, sf).select("protein_id", F.sha2(X.sanitize(F.col("sequence")), 256).alias("digest"))


@query("p3_quality_report", """WITH d AS (SELECT doc_id::VARCHAR AS protein_id, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS s FROM documents),
b AS (SELECT protein_id, list_sort(list_distinct(string_split(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWYBXZUO-]', '', 'g'), ''))) AS bad FROM d)
SELECT protein_id, 'bad_symbols' AS reason, array_to_string(bad, ',') AS symbols FROM b WHERE array_to_string(bad, '') <> ''""")
def p3(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("protein_id"), F.upper(F.regexp_replace("text", "[^A-Za-z0-9]", "")).alias("sequence"))
    return clean.quality_report(rows, labelled=False).select("protein_id", "reason", F.array_join("symbols", ",").alias("symbols"))


@query("p4_positions", f"WITH {EVENT_RESIDUES} SELECT protein_id, position, symbol, label FROM ev")
def p4(spark, sf):
    return clean.to_positions(event_sequences(spark, sf))


@query("p6_label_values", f"{ES} SELECT protein_id, i::INT AS position, CASE substr(labels, i, 1) WHEN '1' THEN 1 WHEN '0' THEN 0 END::INT AS label FROM (SELECT *, unnest(range(1, length(labels) + 1)) AS i FROM es)")
def p6(spark, sf):
    return clean.to_positions(event_sequences(spark, sf)).select("protein_id", "position", "label")


@query("p7_safe_key", r"""WITH n AS (SELECT 'page' AS kind, page_id AS id, url AS name FROM pages UNION ALL SELECT 'document', doc_id, ' ' || substr(text, 1, 40) || chr(160) FROM documents),
k AS (SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(name, '^[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+$', '', 'g'), '[/\\]', '_', 'g'), '[^\p{L}\p{N}_.\-]+', '_', 'g') AS key FROM n)
SELECT kind, id, CASE WHEN key = '' THEN 'empty_id' ELSE key END AS key FROM k""")
def p7(spark, sf):
    """Addresses, and beginnings of texts in several languages between blanks."""
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    texts = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit(" "), F.substring("text", 1, 40), F.lit("\u00a0")).alias("name"))
    return pages.unionByName(texts).select("kind", "id", X.safe_key(F.col("name")).alias("key"))


@query("p8_with_positive", f"{ES} SELECT protein_id, sequence, labels FROM es WHERE contains(labels, '1')")
def p8(spark, sf):
    return clean.with_positive(event_sequences(spark, sf)).select("protein_id", "sequence", "labels")


@query("p8_positive_report", f"""{ES}, m AS (SELECT labels, length(labels) - length(replace(labels, '1', '')) AS pos, length(labels) - length(replace(labels, '0', '')) AS neg, length(labels) - length(replace(labels, '-', '')) AS masked FROM es),
s AS (SELECT 'before' AS stage, * FROM m UNION ALL SELECT 'after', * FROM m WHERE pos > 0) SELECT stage, count(*) AS records, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(masked)::BIGINT AS masked FROM s GROUP BY stage""")
def p8_report(spark, sf):
    return clean.with_positive_report(event_sequences(spark, sf))


@query("p9_select_records", f"WITH {DOCUMENT_SEQUENCES}, l AS (SELECT DISTINCT doc_id::VARCHAR AS protein_id FROM labels WHERE quality = 1) SELECT protein_id, length(sequence)::INT AS n FROM ds SEMI JOIN l USING (protein_id)")
def p9(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("protein_id"))
    return clean.select_records(document_sequences(spark, sf), wanted).select("protein_id", F.length("sequence").alias("n"))


@query("p13_low_complexity", f"""WITH {EVENT_RESIDUES}, s AS (SELECT protein_id, symbol, count(*) AS n FROM ev GROUP BY ALL)
SELECT protein_id, round(0.7 * (sum(n) FILTER (contains('PGSEDKRNQ', symbol)) / sum(n)::DOUBLE) + 0.3 * (max(n) / sum(n)::DOUBLE), 9) AS score FROM s GROUP BY protein_id""")
def p13(spark, sf):
    return event_sequences(spark, sf).select("protein_id", F.round(X.low_complexity(F.col("sequence")), 9).alias("score"))


@query("j1_labelled_pairs", f"""WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}, other AS (SELECT protein_id, CASE WHEN protein_id::BIGINT % 7 = 0 THEN sequence || 'X' ELSE sequence END AS sequence2 FROM es WHERE protein_id::BIGINT % 11 <> 0)
SELECT e.protein_id, CASE WHEN sequence2 IS NULL THEN 'missing' WHEN sequence <> sequence2 THEN 'mismatch' ELSE 'ok' END AS status FROM es e LEFT JOIN other o ON e.protein_id = o.protein_id""")
def j1(spark, sf):
    from seqweave.operators.joins import labelled_pairs

    rows = event_sequences(spark, sf)
    n = F.col("protein_id").cast("long")
    other = rows.where(n % 11 != 0).select("protein_id", F.when(n % 7 == 0, F.concat("sequence", F.lit("X"))).otherwise(F.col("sequence")).alias("sequence"))
    return labelled_pairs(rows, other).select("protein_id", "status")


@query("j2_seeded_split", f"""WITH {IDS}, o AS (SELECT protein_id, row_number() OVER (ORDER BY md5(protein_id || ':42'), protein_id) AS i, count(*) OVER () AS n FROM elig)
SELECT protein_id, CASE WHEN i <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM o""")
def j2(spark, sf):
    return splits.seeded_split(*_ids(spark, sf))


@query("j3_fixed_split", f"""WITH {IDS} SELECT protein_id, CASE WHEN protein_id::BIGINT % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM elig""")
def j3(spark, sf):
    ids, error, hold = _ids(spark, sf)
    n = F.col("protein_id").cast("long")
    return splits.fixed_split(ids.where(n % 4 != 0), ids.where(n % 4 == 0), error, hold)


@query("j4_manifest_check", """WITH m AS (SELECT doc_id::VARCHAR AS protein_id, CASE WHEN quality = 1 THEN 'train' ELSE 'val' END AS split FROM labels),
l AS (SELECT m.*, o.o_orderkey IS NULL AS lost FROM m LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) o ON m.protein_id = o.o_orderkey::VARCHAR)
SELECT split, count(*) AS listed, count(*) FILTER (lost) AS missing, array_to_string(list_sort(list(protein_id) FILTER (lost))[1:10], ',') AS sample FROM l GROUP BY split""")
def j4(spark, sf):
    manifest = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("protein_id"), F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    records = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("protein_id"))
    return splits.resolve_manifest(records, manifest).withColumn("sample", F.array_join("sample", ","))


@query("j4_use_or_rebuild", """WITH m AS (SELECT doc_id::VARCHAR AS protein_id, CASE WHEN quality = 1 THEN 'train' ELSE 'val' END AS split FROM labels),
d AS (SELECT DISTINCT doc_id::VARCHAR AS protein_id FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM labels)),
o AS (SELECT protein_id, row_number() OVER (ORDER BY md5(protein_id || ':42'), protein_id) AS i, count(*) OVER () AS n FROM d)
SELECT 'used' AS status, protein_id, split FROM m UNION ALL
SELECT 'rebuilt', protein_id, CASE WHEN i <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END FROM o""")
def j4_use_or_rebuild(spark, sf):
    """The labels as a manifest of the documents, which fits, and of the documents without one of them, which doesn't."""
    manifest = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("protein_id"), F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    records = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("protein_id"))
    lost = table(spark, sf, "labels").agg(F.min("doc_id").cast("string").alias("protein_id"))
    out = []
    for known in (records, records.join(lost, "protein_id", "left_anti")):
        split, status, _ = splits.use_or_rebuild(known, manifest, records.limit(0), records.limit(0))
        out.append(split.select(F.lit(status).alias("status"), "protein_id", "split"))
    return out[0].unionByName(out[1])


@query("j5_leakage", f"WITH {IDS} SELECT protein_id FROM ids SEMI JOIN hold USING (protein_id)")
def j5(spark, sf):
    ids, _, hold = _ids(spark, sf)
    return splits.leaked(ids, hold)


@query("a19_exclusion_counts", f"""WITH {IDS} SELECT CASE WHEN protein_id IN (SELECT protein_id FROM err) THEN 'error' WHEN protein_id IN (SELECT protein_id FROM hold) THEN 'holdout' ELSE 'eligible' END AS status, count(*) AS n
FROM ids GROUP BY 1 UNION ALL SELECT 'error_missing', count(*) FROM err ANTI JOIN ids USING (protein_id)""")
def a19(spark, sf):
    return splits.exclusion_counts(*_ids(spark, sf))
