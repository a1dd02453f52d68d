"""Queries of this folder's operators, each over its whole table, and their checks in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blastradius.llm import divergence, exact_dedup, fingerprint, jaccard, language, license, negatives, packing, pieces, pii, quality, rules, warc
from blastradius.llm.common import table, workspace

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), f"{workspace(spark).root}/archives")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), words=3, share=(90, 100))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_document_fingerprints,
        op3_warc,
        op4_language_id,
        op5_best_fit_packing,
        op6_ngram_jaccard_join,
        op7_pii,
        op8_quality_classifier,
        op9_exact_dedup,
        op10_sentencepiece,
        op11_quality_rules,
        op12_source_divergence_audit,
        op13_hard_negative_mining,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT f.page_id, url, payload_bytes, payload_digest,
               CASE WHEN f.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.page_id <> first THEN first END AS refers_to
        FROM f JOIN pages USING (page_id)""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    # A cutoff is certified by the sum of the binomial's terms, here from the logarithm of the gamma function.
    "op11_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents
        ), v AS (
            SELECT i, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t, p FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS p FROM d)
        ), r AS (
            SELECT i, count(DISTINCT p + o) AS n FROM (SELECT i, p FROM v QUALIFY count(*) OVER (PARTITION BY i, t) > 1), range(3) AS x(o) GROUP BY i
        ), m AS (
            SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
            FROM d LEFT JOIN r USING (i)
        ), b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
        ), c AS (
            SELECT rule, generate_subscripts(cuts, 1) AS place, unnest(cuts) AS cutoff FROM (VALUES
                ('symbols', [400, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10]),
                ('repeated_lines', [900, 800, 700, 650, 600, 550, 500, 450, 400, 350, 300]),
                ('repeated_words', [480, 450, 400, 350, 300, 250, 200, 150, 100]),
                ('long_words', [20000, 16000, 14000, 12000, 11000, 10000, 9000, 8500, 8000]),
                ('short_words', [1500, 2000, 2500, 2750, 3000, 3250])) AS t(rule, cuts)
        ), y AS (
            SELECT b.*, q > 0 AS good FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed AND q IS NOT NULL
        ), k AS (
            SELECT stratum, rule, place, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND beyond) AS k, count(*) FILTER (NOT good AND beyond) AS bad, count(*) FILTER (NOT good) AS n_bad
            FROM (SELECT stratum, good, rule, place, cutoff, CASE rule
                    WHEN 'symbols' THEN 1000 * n_symbols > cutoff * word_chars WHEN 'repeated_lines' THEN 1000 * n_dup_lines > cutoff * n_lines
                    WHEN 'repeated_words' THEN 1000 * n_repeat_words > cutoff * n_words WHEN 'long_words' THEN 1000 * word_chars > cutoff * n_words
                    ELSE 1000 * word_chars < cutoff * n_words END AS beyond FROM y, c)
            GROUP BY ALL
        ), p AS (
            SELECT k.*, 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM y)) AS level, CASE WHEN k > n * 0.004 THEN 1 ELSE
                list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.004) + (n - j) * ln(0.996)))) END AS probability
            FROM k
        ), s AS (
            SELECT *, bool_and(probability <= level) OVER (PARTITION BY stratum, rule ORDER BY place) AS certified FROM p
        ), f AS (
            SELECT stratum, rule, cutoff FROM (
                SELECT *, max(bad) OVER (PARTITION BY stratum, rule) AS most FROM s
                WHERE certified AND bad > 0 AND bad::DOUBLE * n::DOUBLE >= 10 * k::DOUBLE * n_bad::DOUBLE
            ) WHERE 100 * bad >= 98 * most QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY place) = 1
        ), z AS (
            SELECT stratum, any_value(cutoff) FILTER (rule = 'symbols') AS a, any_value(cutoff) FILTER (rule = 'repeated_lines') AS b, any_value(cutoff) FILTER (rule = 'repeated_words') AS c,
                   any_value(cutoff) FILTER (rule = 'long_words') AS d, any_value(cutoff) FILTER (rule = 'short_words') AS e FROM f GROUP BY stratum
        ), t AS (
            SELECT b.* EXCLUDE stratum, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', CASE WHEN 1000 * n_symbols > a * word_chars THEN 'symbols' END,
                CASE WHEN 1000 * n_dup_lines > z.b * n_lines THEN 'repeated_lines' END, CASE WHEN 1000 * n_repeat_words > c * n_words THEN 'repeated_words' END,
                CASE WHEN 1000 * word_chars > d * n_words THEN 'long_words' END, CASE WHEN 1000 * word_chars < e * n_words THEN 'short_words' END) END AS rejected_by
            FROM b LEFT JOIN z USING (stratum)
        )
        SELECT *, rejected_by = '' AS kept FROM t""",
    "op12_source_divergence_audit": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), w AS (
            SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10
        ), l AS (
            SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT d.lang, d.source, coalesce(v, 0) AS v, coalesce(any_value(t.n), 0) AS n
            FROM (SELECT DISTINCT lang, source FROM d) AS d LEFT JOIN l USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) AS t USING (lang, source)
            GROUP BY ALL
        ), m AS (
            SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)
        ), r AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item,
                   coalesce((SELECT sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) FROM m AS a JOIN m AS b USING (lang, term)
                             WHERE a.lang = x.lang AND a.source = x.source AND b.source = y.source), 0) AS value
            FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM m WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER w ::INTEGER AS rank FROM r
        WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
        QUALIFY part = 'pair' OR row_number() OVER w <= 10""",
    "op13_hard_negative_mining": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM r AS a, r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER w ::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
        QUALIFY row_number() OVER w <= 3""",
}
