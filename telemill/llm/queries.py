"""The registered queries of this package and, where SQL can express them, their SQL."""

import public_tokenizers

from telemill.llm import (
    centroids,
    exact,
    language,
    lines,
    minmax,
    mixing,
    negatives,
    pieces,
    quality,
    search,
    secrets,
    toxicity,
    vectors,
)
from telemill.llm.staging import table


def op1_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op2_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op4_lattice_dedup(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_tokens(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_minmax_dedup(spark, sf_dir):
    found = minmax.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark, sf_dir):
    return exact.dedup(spark, f"{sf_dir}/documents.parquet")


def op10_secret_scan(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_topk_search(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op13_centroid_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mix,
        op3_line_dedup,
        op4_lattice_dedup,
        op5_toxicity,
        op6_piece_tokens,
        op7_minmax_dedup,
        op8_quality,
        op9_exact_dedup,
        op10_secret_scan,
        op11_hard_negatives,
        op12_topk_search,
        op13_centroid_clusters,
    )
}

#: Fixed SQL pieces: integer vectors of finite rows, and the integer inner product of two of them.
_INTEGER_VECTORS = """iv AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
                AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
        )"""
_INNER = "coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), 0)"

ORACLES = {
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
        ), counted AS (
            SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM keyed
            WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT doc_id, k, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN counted USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept,
            sha256(normal) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY normal)""",
    "op11_hard_negatives": f"""
        WITH {_INTEGER_VECTORS.format(scale=256)}, v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM iv
            WHERE label IS NOT NULL
        ), a AS (SELECT DISTINCT vec_id AS anchor_id, label AS a_label, e AS a_e FROM v WHERE vec_id % 100 = 0),
        s AS (
            SELECT anchor_id, a_label, a_e, v.vec_id, v.label,
                {_INNER.format(a="a_e", b="v.e")} AS score
            FROM a JOIN v ON v.vec_id IS DISTINCT FROM anchor_id AND len(v.e) = len(a_e)
        ), p AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY anchor_id, a_label, a_e ORDER BY score DESC, vec_id NULLS LAST) AS k
                FROM s WHERE label = a_label
            ) WHERE k <= 5
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
                s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.a_label, p.a_e, p.vec_id, p.k
                    ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.a_label = p.a_label AND s.a_e = p.a_e
                AND s.label <> p.a_label AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 5""",
    "op12_topk_search": f"""
        WITH {_INTEGER_VECTORS.format(scale=256)},
        q AS (SELECT DISTINCT vec_id AS query_id, e AS q_e FROM iv WHERE vec_id % 50 = 0),
        s AS (
            SELECT query_id, q_e, iv.vec_id, {_INNER.format(a="q_e", b="iv.e")} AS score
            FROM q JOIN iv ON iv.vec_id IS DISTINCT FROM query_id AND len(iv.e) = len(q_e)
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, q_e ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
        ) WHERE rank <= 5""",
}

