"""Registered queries of the training-data operators, each over its whole
table with production parameters, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelab.llm import ctph, hyperminhash, hyperplanes, impacts, merkle, mixing, packing, pii, preferences, quality, toxicity, warc, whitening
from probelab.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted)


def op2_mixing(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op3_preference_formatting(spark, sf_dir):
    return preferences.format_preferences(*preferences.stale_reply_pairs(_table(spark, sf_dir, "conversations")))


def op4_fingerprints(spark, sf_dir):
    return ctph.fingerprints(_table(spark, sf_dir, "documents"))


def op5_minhash(spark, sf_dir):
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), n_words=3, threshold=85)


def op6_packing(spark, sf_dir):
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    read = warc.read_archives(*warc.write_archives(_table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.fit(docs, _table(spark, sf_dir, "labels")).score(docs)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_pii(spark, sf_dir):
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark, sf_dir):
    return hyperplanes.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.audit(merkle.manifest(_table(spark, sf_dir, "documents")))


def op13_exact_top_k(spark, sf_dir):
    return impacts.top_k(_table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_preference_formatting, op4_fingerprints, op5_minhash,
                            op6_packing, op7_warc, op8_toxicity, op9_pii, op10_embedding_dedup, op11_whitening, op12_merkle_manifest, op13_exact_top_k)}

SQL: dict[str, str] = {
    "op3_preference_formatting": """
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS l FROM t WHERE role = 'assistant' GROUP BY 1),
upto AS (SELECT t.*, l FROM t JOIN last USING (pair_id) WHERE turn <= l),
before AS (SELECT pair_id, l AS turn, 'assistant' AS role, arg_max(text, turn) AS text FROM upto WHERE role = 'assistant' AND turn < l GROUP BY 1, 2),
c AS (SELECT pair_id, turn, role, text, true AS here FROM upto),
r AS (SELECT pair_id, turn, role, text, true AS here FROM upto WHERE turn < l UNION ALL SELECT *, true FROM before),
b AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS crole, c.text AS ctext, c.here AS chere,
             r.role AS rrole, r.text AS rtext, r.here AS rhere FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn),
s AS (SELECT *, min(CASE WHEN chere IS DISTINCT FROM rhere OR crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN turn END)
             OVER (PARTITION BY pair_id) AS split FROM b),
p AS (SELECT pair_id, 'prompt' AS part, turn, crole AS role, ctext AS text FROM s WHERE split IS NULL OR turn < split
      UNION ALL SELECT pair_id, 'chosen', turn, crole, ctext FROM s WHERE turn >= split AND chere
      UNION ALL SELECT pair_id, 'rejected', turn, rrole, rtext FROM s WHERE turn >= split AND rhere)
SELECT pair_id, part, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment,
       part <> 'prompt' AND role IS NOT DISTINCT FROM 'assistant' AS loss FROM p""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM m""",
    "op12_merkle_manifest": """
WITH RECURSIVE f AS (SELECT doc_id, coalesce('+' || source, '') AS g, text, row_number() OVER () AS rid,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
l AS (SELECT doc_id, g, rid, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) & 1 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
up AS (SELECT g, 0 AS level, pos, leaf AS digest, n FROM d
    UNION ALL SELECT g, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY g, level, pos // 3, n),
sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS digest, n FROM sub
    UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
step AS (SELECT rid, level AS step, d.pos // CAST(3 ** level AS BIGINT) AS own, u.pos, u.digest FROM d JOIN up u ON u.g = d.g AND u.n > 1 AND u.pos // 3 = d.pos // CAST(3 ** (level + 1) AS BIGINT)
    UNION ALL SELECT rid, 1000 + level, s.pos // CAST(3 ** level AS BIGINT), t.pos, t.digest FROM d JOIN sub s USING (g) JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // CAST(3 ** (level + 1) AS BIGINT)),
side AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS r FROM step GROUP BY rid, step),
fold AS (SELECT rid, CAST(0 AS BIGINT) AS k, coalesce(changed, leaf) AS digest FROM d
    UNION ALL SELECT rid, side.k, sha256(l || digest || r) FROM fold JOIN side USING (rid) WHERE side.k = fold.k + 1),
proof AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS p FROM side GROUP BY rid)
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(coalesce(p, '')) AS proof_sha256, e.digest AS folded_root, e.digest = top.digest AS verified
FROM d JOIN sub USING (g) JOIN top ON top.n = 1 LEFT JOIN proof USING (rid) JOIN (SELECT rid, arg_max(digest, k) AS digest FROM fold GROUP BY rid) e USING (rid)""",
    "op13_exact_top_k": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, q.row, c.vec_id, c.row AS other, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
