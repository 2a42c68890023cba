"""The corpus operators' queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import public_file
    from .pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"), check=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    shards = shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents, with_digest

    return with_digest(pack_documents(table(spark, sf_dir, "documents"), width=1024))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    root = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import host_quality

    return host_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lines": op1_lines,
        "op2_pieces": op2_pieces,
        "op3_sharding": op3_sharding,
        "op4_html": op4_html,
        "op5_packing": op5_packing,
        "op6_warc": op6_warc,
        "op7_neardup": op7_neardup,
        "op8_scoring": op8_scoring,
        "op9_neighbours": op9_neighbours,
        "op10_quality": op10_quality,
        "op11_centroids": op11_centroids,
        "op12_divergence": op12_divergence,
        "op13_toxicity": op13_toxicity,
        "pipeline": pipeline,
    }


WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The metrics, base rules and host verdicts of op10; the prior is the method of moments over hosts.
QUALITY = rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, source, t, {WORDS} AS ws FROM w),
g AS (SELECT doc_id, source, t, ws, list_transform(range(1, greatest(len(ws) - 6, 1)), lambda i: array_to_string(ws[i:i + 7], ' ')) AS gs FROM x),
p AS (SELECT doc_id, g, list(i ORDER BY i) AS places FROM (SELECT doc_id, unnest(gs) AS g, unnest(range(1, len(gs) + 1)) AS i FROM g) GROUP BY doc_id, g HAVING count(*) > 1),
q AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT doc_id, unnest(places) AS i FROM p)),
r AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS rep FROM q GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT s) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM w) WHERE regexp_matches(s, '[^ 	-
]') GROUP BY doc_id),
m AS (SELECT g.doc_id, source, len(ws) AS n, list_sum(list_transform(ws, lambda y: length(y))) AS c, length(t) - length(translate(t, '#*$%&|<>', '')) AS s, coalesce(dup, 0) AS d, coalesce(rep, 0) AS e FROM g LEFT JOIN r ON g.doc_id = r.doc_id LEFT JOIN l ON g.doc_id = l.doc_id),
v AS (SELECT *, n < 20 OR 100 * e > 30 * n AS base, s * 2 > n AS severe, s * 10 > n OR 100 * e > 20 * n OR d * 20 > n OR c > 10 * n OR c < 3 * n AS mild FROM m),
h AS (SELECT source, count(*) AS k, sum(CASE WHEN base OR severe OR mild THEN 1 ELSE 0 END) AS f FROM v GROUP BY source),
pr AS (SELECT mu, greatest(va - mu * (1 - mu) * iv, 1e-6) AS va FROM (SELECT avg(f / k) AS mu, var_pop(f / k) AS va, avg(1 / k) AS iv FROM h)),
ab AS (SELECT mu * we AS a, (1 - mu) * we AS b FROM (SELECT mu, least(greatest(mu * (1 - mu) / va - 1, 1.0), 1e4) AS we FROM pr)),
hv AS (SELECT source, (f + a) / (k + a + b) > 0.4 AS bad FROM h, ab)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS word_chars, CAST(s AS BIGINT) AS n_symbols, CAST(d AS BIGINT) AS n_dup_lines, CAST(e AS BIGINT) AS n_repeat_words, base AS base_failed, NOT base AND NOT severe AND NOT (mild AND bad) AS kept
FROM v JOIN hv ON v.source IS NOT DISTINCT FROM hv.source"""

#: Page records: digests in base32, the largest page_id of equal payloads as the response.
WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
o AS (SELECT page_id, n, hex, list_transform(range(0, 4), lambda k: CAST('0x' || substr(hex, 1 + 10 * k, 10) AS BIGINT)) AS five FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((five[1 + i // 8] >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> max(page_id) OVER (PARTITION BY hex) THEN max(page_id) OVER (PARTITION BY hex) END AS refers_to FROM o"""



def _centroids(rounds: int = 3) -> str:
    """Lloyd's rounds in SQL, over all kept vectors one by one: c0, c1, ... are the centroids, a0, a1, ... the assignments."""
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT 16))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, vec_id, q, first(cluster ORDER BY d, cluster) AS cluster, min(d) AS distance FROM
(SELECT r, vec_id, q, cluster, CAST(list_sum(list_transform(range(1, 65), lambda k: (q[k] - c[k]) * (q[k] - c[k]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r, vec_id, q)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY k) AS c FROM (SELECT cluster, k, sum(q[k]) AS s, count(*) AS n FROM a{i}, range(1, 65) g(k) GROUP BY cluster, k) GROUP BY cluster),
c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.cluster = m{i}.cluster)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster"""


#: Shares of every kept term in every group and language, dense.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 5)::HUGEINT // CAST(sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS HUGEINT) AS BIGINT) AS p FROM c),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 * (n + 5)::HUGEINT // CAST(sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang) AS HUGEINT) AS BIGINT) AS q FROM l),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
te AS (SELECT p.lang, source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
un AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pa UNION ALL SELECT * FROM te))
SELECT lang, source, part, item, value, rank FROM un WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC, "op10_quality": QUALITY, "op11_centroids": _centroids(), "op12_divergence": DIVERGENCE}
