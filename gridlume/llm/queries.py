"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlume.llm import chat, fill_in_middle, fingerprints, media, mixing, near_dedup, packing, quality, quality_rules, token_counts, toxicity, url_filters, vector_codes
from gridlume.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(pages, url_filters.marked_pages(pages), by=("host", "path"), bits_per_key=4, hashes=3)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures(table(spark, sf_dir, "embeddings")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], said.schema)
    return chat.digests(chat.format_conversations(said.union(extra)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_near_dedup, op4_toxicity, op5_token_counts, op6_fingerprints, op7_url_filters, op8_media, op9_chat, op10_quality, op11_fill_in_middle, op12_vector_codes, op13_quality_rules)}

_mixing_sql = r"""
WITH words AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS ord
  FROM documents),
sources AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM words GROUP BY no_source, src),
levels AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_level
  FROM sources),
targets AS (
  SELECT *, round(least(CAST(3 * source_size AS DOUBLE), coalesce(max(own_level) OVER (), 0) * weight), 6) AS target
  FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT w.doc_id, w.size, p.source_size, p.target, p.whole, CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS budget,
         sum(w.size) OVER (PARTITION BY w.no_source, w.src ORDER BY w.ord, w.doc_id) - w.size AS before
  FROM words w JOIN plans p ON w.no_source = p.no_source AND w.src = p.src)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken
FROM placed
"""

_url_sql = r"""
WITH parts AS (
  SELECT page_id, html, coalesce(regexp_extract(url, '^[\s\S]*?://([\s\S]*)$', 1), '') AS rest FROM pages),
split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
listed AS (SELECT DISTINCT host || path AS key FROM split WHERE regexp_matches(html, '[*$%#]{3}|!! | \| ') AND host || path <> ''),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_chat_sql = r"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(17 + 2 * length(role) - length(translate(role, '\[<', '')) + 2 * length(text) - length(translate(text, '\[<', ''))) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM said GROUP BY conv_id
"""


_fim_sql = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM pieces),
cut AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(list_slice(tokens, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS prefix,
         array_to_string(list_slice(tokens, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS middle,
         array_to_string(list_slice(tokens, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS suffix FROM hashed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """All rounds unrolled, each comparing every part with every entry of its codebook."""
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings"
        " WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "comps AS MATERIALIZED (SELECT r, (i * 4) // len AS part, i % (len // 4) AS pos, CAST(floor(CAST(v AS DOUBLE) * 1024) AS BIGINT) AS x"
        " FROM (SELECT r, len(embedding) AS len, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept))",
        "books0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM comps WHERE r < 256)",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"near{k} AS MATERIALIZED (SELECT r, part, min(d * 256 + entry) AS best FROM (SELECT c.r, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d"
            f" FROM comps c JOIN books{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY c.r, c.part, b.entry) GROUP BY r, part)"
        )
        if k < rounds:
            ctes.append(
                f"books{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) AS x FROM books{k} b LEFT JOIN"
                f" (SELECT c.part, n.best % 256 AS entry, c.pos, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n FROM comps c JOIN near{k} n ON c.r = n.r AND c.part = n.part GROUP BY ALL) m"
                " ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"
            )
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY r)")
    return (
        f"WITH {', '.join(ctes)} SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,"
        f" (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM books{rounds}) AS codebooks_sha256 FROM kept k JOIN coded c ON k.r = c.r"
    )


_rules_sql = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
placed AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
spans AS (SELECT r, i, w, lead(w, 1) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM placed),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM spans WHERE w3 IS NOT NULL) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS spot FROM twice) GROUP BY r),
measured AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(i.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_bare, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_cut,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_list
  FROM docs d LEFT JOIN inside i ON d.r = i.r),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * n_bare > 20 * n_words OR 100 * n_capitals > 60 * n_letters OR 100 * n_cut > 30 * n_lines OR 100 * n_list > 90 * n_lines) AS kept
FROM based
"""

ORACLE_SQL = {
    "op2_mixing": _mixing_sql,
    "op7_url_filters": _url_sql,
    "op9_chat": _chat_sql,
    "op11_fill_in_middle": _fim_sql,
    "op12_vector_codes": _codes_sql(),
    "op13_quality_rules": _rules_sql,
}
