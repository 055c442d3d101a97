"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import alignment, decontamination, divergence, fingerprints, pieces, pseudonyms, quality, repetition, sharding, simhash, substrings, tokencounts, tokenstore
from veldt.llm.common import sha256, shared_path, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    tokenstore.write(table(spark, sf_dir, "documents"), path)
    return tokenstore.checksums(spark, path)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = quality.score(features, model)
    return found.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    mark = F.col("contamination")
    return found.select("doc_id", mark["n_words"].alias("n_words"), decontamination.n_hit().alias("n_hit"), F.size(mark["items"]).cast("bigint").alias("n_items"), sha256(F.array_join(mark["items"], ",")).alias("items_sha256"), decontamination.is_contaminated().alias("contaminated"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), "key of the test tables")
    return found.select("doc_id", "text", F.size("pii").alias("n_found"), "pii")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every paragraph of every document; a token that crosses a line end counts where it begins."""
    found = tokencounts.count(table(spark, sf_dir, "documents"), F.col("text"), "lines")
    tokens = F.transform("sections", lambda s: s["tokens"].cast("bigint"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.size("sections").cast("bigint").alias("n_sections"), tokens.alias("section_tokens"), F.col("n_outside").cast("bigint").alias("n_outside"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.as_text(F.col("v")).alias("fingerprint"), fingerprints.as_text(F.col("edited_v")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), groups="digest")
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.count_repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"repetition.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, repetition.base_failed().alias("base_failed"), repetition.is_kept().alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_id_output": op2_token_id_output,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_sentencepiece_codec": op5_sentencepiece_codec,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_sharding": op10_sharding,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_rules": op13_quality_rules,
}

_WORDS_4 = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP4 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_4} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i:least(i + 12, len(w))], ' ') AS k, least(13, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS_4} AS w FROM documents),
p AS (SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT n FROM win) z WHERE i + z.n - 1 <= len(w)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN win ON p.k = win.k AND p.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

_OP8 = """
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE rn > 1),
a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN g ON g.doc_id = x.doc_id AND g.j = x.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(gone), 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
f AS (SELECT g.lang, g.source, kept.term, COALESCE(c.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT f.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY f.lang, source) + 5 * v) AS p FROM f JOIN v ON v.lang = f.lang),
l AS (SELECT f.lang, term, sum(n) AS n FROM f GROUP BY 1, 2),
q AS (SELECT l.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY l.lang) + 5 * v) AS q FROM l JOIN v ON v.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 50"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
e AS (SELECT *, list_transform(l, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS lc, list_transform(list_distinct(l), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS uc FROM b),
h AS (SELECT r, n, i FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (3), (5)) z(n) WHERE len(w) >= n)) QUALIFY count(*) OVER (PARTITION BY r, n, k) > 1),
p AS (SELECT d.r, z.n, i, array_to_string(w[i:i + z.n - 1], ' ') AS k FROM h JOIN d ON d.r = h.r AND h.n = 5, (VALUES {", ".join(f"({n})" for n in repetition.LENGTHS)}) z(n) WHERE i + z.n - 1 <= len(w)),
u AS (SELECT r, n, i FROM p QUALIFY row_number() OVER (PARTITION BY r, n, k ORDER BY i) > 1 UNION ALL SELECT r, n, i FROM h WHERE n = 3),
j AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS j FROM u),
m AS (SELECT j.r, count(*) FILTER (n = 3) AS n_repeat_words, {", ".join(f"sum(length(w[j])) FILTER (n = {n}) AS c{n}" for n in repetition.LENGTHS)} FROM j JOIN d ON d.r = j.r GROUP BY 1),
y AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(uc) AS BIGINT) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * COALESCE(n_repeat_words, 0) > 50 * n_words AS base_failed, len(l) AS n_lines, COALESCE(list_sum(lc), 0) - COALESCE(list_sum(uc), 0) AS dup_line_chars, {", ".join(f"COALESCE(c{n}, 0) AS c{n}" for n in repetition.LENGTHS)} FROM e LEFT JOIN m ON m.r = e.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > {repetition.SYMBOL_SHARE} * n_words OR 100 * n_dup_lines > {repetition.LINE_SHARE} * n_lines OR 100 * dup_line_chars > {repetition.LINE_CHARS} * word_chars OR {" OR ".join(f"100 * c{n} > {share} * word_chars" for n, share in repetition.ALLOWED.items())}) AS kept FROM y"""

#: The other operators hash, tokenise, fit or pack in ways that SQL has no form for; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": _OP4, "op8_substring_dedup": _OP8, "op12_source_divergence": _OP12, "op13_quality_rules": _OP13}
