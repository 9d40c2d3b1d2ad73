"""The queries of this subpackage for ``__spark_entry__``: thin wrappers that
apply each operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, common, embedding_dedup, exact_dedup, filter_audit, html, language_id, line_dedup, near_dedup, packing, quality, secrets, sentencepieces, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark, sf_dir):
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark, sf_dir):
    """With a cache of its own, so that every call shows the cost of a cold one."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.shared_path(spark, "token-cache"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_curve_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"), similarity=near_dedup.EDITED)


def op7_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sentencepiece_dropout(spark, sf_dir):
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_secret_scan(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_line_dedup(spark, sf_dir):
    found = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_html_main_text,
    op2_token_counts,
    op3_exact_dedup,
    op4_language_id,
    op5_curve_packing,
    op6_minhash_near_dedup,
    op7_embedding_near_dedup,
    op8_quality_classifier,
    op9_sentencepiece_dropout,
    op10_secret_scan,
    op11_filter_audit,
    op12_line_dedup,
    op13_phrase_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB SQL with the same rows, where SQL can express the operator.
ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM norm""",
    "op11_filter_audit": r"""
        WITH words AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        failing AS (
            SELECT part, doc_id,
                   (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
                   + 8 * regexp_matches(t, '[#$%&*|]')::int
                   + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::int AS mask
            FROM words),
        marked AS (
            SELECT f.part, f.mask, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
            FROM failing f LEFT JOIN labels l USING (doc_id)),
        letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (
            SELECT filter_order, step::int AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::int AS before
            FROM orders, range(1, 6) r(step)),
        cells AS (SELECT part, mask, good, toxic, count(*) AS n FROM marked GROUP BY ALL)
        SELECT part, filter_order, step,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0)::bigint AS kept,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::bigint AS removed,
               coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::bigint AS redundant,
               coalesce(sum(n) FILTER (mask = own), 0)::bigint AS unique_fails,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND good), 0)::bigint AS good_lost,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND toxic), 0)::bigint AS toxic_lost,
               coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::bigint AS shapley
        FROM cells, steps GROUP BY ALL""",
    "op12_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
        keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM each),
        common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT doc_id, line, i, k IN (SELECT k FROM common) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_phrase_collocations": r"""
        WITH pieces AS (
            SELECT lang, piece, row_number() OVER () AS p
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)),
        words AS (
            SELECT lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i
            FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
        near AS (
            SELECT lang, word AS w1, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3
            FROM words WINDOW x AS (PARTITION BY lang, p ORDER BY i)),
        f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM near GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM near WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM near WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        longer AS (
            SELECT lang, phrase, max(f) AS f
            FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
        cuts AS (
            SELECT t.lang, t.phrase, t.f AS a, l.f AS l, r.f AS r, 1 AS k
            FROM f2 t JOIN f1 l ON l.lang = t.lang AND l.phrase = t.w1 JOIN f1 r ON r.lang = t.lang AND r.phrase = t.w2
            LEFT JOIN longer o ON o.lang = t.lang AND o.phrase = t.phrase
            WHERE o.f IS NULL OR 100 * o.f < 50 * t.f
            UNION ALL
            SELECT t.lang, t.phrase, t.f, l.f, r.f, 1
            FROM f3 t JOIN f1 l ON l.lang = t.lang AND l.phrase = t.w1 JOIN f2 r ON r.lang = t.lang AND r.phrase = t.w2 || ' ' || t.w3
            UNION ALL
            SELECT t.lang, t.phrase, t.f, l.f, r.f, 2
            FROM f3 t JOIN f2 l ON l.lang = t.lang AND l.phrase = t.w1 || ' ' || t.w2 JOIN f1 r ON r.lang = t.lang AND r.phrase = t.w3),
        scored AS (SELECT *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
