"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import warc

    manifest = warc.write_pages(table(spark, sf_dir, "pages"))
    read = warc.read_archives(manifest, payloads=False).filter("gap is null")
    return read.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm import token_store

    manifest = token_store.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_store.read_token_digests(manifest)


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import lz_fingerprint

    return lz_fingerprint.chained_likeness(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import decontaminate

    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import lm_score, toxicity

    held_out = toxicity.in_fold("doc_id", 7, 2)
    scored = lm_score.scores(table(spark, sf_dir, "documents"), learn=~held_out)
    return scored.withColumn("held_out", held_out).drop("learnt")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import partenum

    return partenum.near_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import chat
    from tidewatch.llm.common import materialize

    pieces = materialize(chat.pieces(table(spark, sf_dir, "conversations")), "transcripts")
    return chat.recovered(pieces, chat.fit(pieces))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.in_fold("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm import chaining

    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm import byte_bpe

    return byte_bpe.digest_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
m AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links
FROM m LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, count(*) AS k FROM e GROUP BY 1) USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_warc_salvage, op2_token_store, op3_lz_fingerprint, op4_decontaminate, op5_context_mixing, op6_ngram_jaccard, op7_transcripts, op8_toxicity, op9_chained_passages, op10_byte_bpe)
}
ORACLES: dict[str, str] = {"op1_warc_salvage": OP1_SQL, "op4_decontaminate": OP4_SQL, "op6_ngram_jaccard": OP6_SQL}
