"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import clusters, covertree, licenses, media, minhash, mixing, packing, periodic, ppm, quality, rules, sharding, toxicity

QUERIES = {
    "op1_cover_tree_topk": covertree.op1_cover_tree_topk,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bestfit_packing": packing.op3_bestfit_packing,
    "op4_license_dice": licenses.op4_license_dice,
    "op5_entropy_mix": mixing.op5_entropy_mix,
    "op6_vector_sharding": sharding.op6_vector_sharding,
    "op7_weak_quality": quality.op7_weak_quality,
    "op8_dart_minhash": minhash.op8_dart_minhash,
    "op9_ppm_lm": ppm.op9_ppm_lm,
    "op10_weak_rules": rules.op10_weak_rules,
    "op11_media_columns": media.op11_media_columns,
    "op12_centroid_clustering": clusters.op12_centroid_clustering,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.place <> q.place AND len(c.e) = len(q.e)
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY place ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op12_centroid_clustering": clusters.sql(),
}
