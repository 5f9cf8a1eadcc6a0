"""Registered queries of the package: each runs one operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.deploy import ship
from fleetpulse.llm import (
    ann, byte_bpe, conversations, exact_dedup, language, mixing, near_dedup, quality, records, repeats, simplex, sql, tokens, warc,
)
from fleetpulse.llm.staging import staged

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.learn(docs.where(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.neighbours(rows.where("vec_id % 20 = 0"), rows, 20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(table(spark, sf_dir, "documents"), digest="text_sha256")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.usage(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(records.write_records(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.report(conversations.damage(rows), rows)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = simplex.cluster(table(spark, sf_dir, "embeddings"))
    found = staged(found, "clusters")
    long = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    hashes = simplex.fingerprints(centroids)
    told = spark.createDataFrame([(r["cluster"], r["total"], hashes[r["cluster"]]) for r in sums], "cluster int, total decimal(38,0), centroid_sha256 string")
    every = F.lit(sum(r["total"] for r in sums)).cast("decimal(38,0)")
    return found.join(F.broadcast(told), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", long(F.col("total")).alias("cluster_inertia"), long(every).alias("inertia"), "centroid_sha256"
    )


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ')) END)) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 75 * (na.n_shingles + nb.n_shingles - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": Query(op1_language_id),
    "op2_nearest_neighbours": Query(op2_nearest_neighbours),
    "op3_quality": Query(op3_quality),
    "op4_token_counts": Query(op4_token_counts),
    "op5_warc": Query(op5_warc, WARC_SQL),
    "op6_exact_dedup": Query(op6_exact_dedup, EXACT_SQL),
    "op7_mixing": Query(op7_mixing),
    "op8_near_dedup": Query(op8_near_dedup, NEAR_SQL),
    "op9_byte_bpe": Query(op9_byte_bpe),
    "op10_token_records": Query(op10_token_records),
    "op11_suffix_dedup": Query(op11_suffix_dedup, sql.SUFFIX),
    "op12_conversation_repair": Query(op12_conversation_repair, sql.conversations()),
    "op13_centroid_clustering": Query(op13_centroid_clustering, sql.clustering(simplex.WIDTH, simplex.CLUSTERS, simplex.ROUNDS, simplex.SCALE)),
}
