"""The corpus queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, imatch, licenses, line_dedup, near_dedup, packing, pieces, quality, toxicity, vector_codes, warc, whitening
from .common import staged


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(parts: int, part: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The I-Match fingerprint of every text and of its edited text, and how like they and the next text are.

    Cases: see imatch; repeated ids are ordered by text, null ids have no next document.
    """
    found = imatch.fingerprints(_documents(spark, sf_dir))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from the labels that are not held out.

    Cases: see quality; a null id is not held out, and repeated rows are scored each.
    """
    docs, held = _documents(spark, sf_dir).select("doc_id", "text"), F.coalesce(_held_out(5, 0), F.lit(False))
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(5, 0)))
    return quality.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every text, learned from the labels that are not held out.

    Cases: see toxicity; a null id is not held out, and repeated rows are scored each.
    """
    docs, held = _documents(spark, sf_dir).select("doc_id", "text"), F.coalesce(_held_out(3, 1), F.lit(False))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(3, 1)))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every row of equal texts, and the digest of each normalised text.

    Cases: see exact_dedup; null texts are empty, repeated rows of the staying id are all kept.
    """
    found = exact_dedup.exact_groups(_documents(spark, sf_dir), hash_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids every text has under the piece model, and digests of the ids and of the text decoded from them.

    Cases: see pieces; null texts are empty and have no ids, repeated rows are encoded each.
    """
    return pieces.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archive written for all pages, as read back from it; a damaged one is an error.

    Cases: see warc; null payloads are empty, equal payloads are revisits of the smallest id.
    """
    chunks = staged(warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return warc.sound(warc.read_archive(chunks))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document.

    Cases: see near_dedup; texts without words are linked with nothing, null ids take no part and are kept.
    """
    return near_dedup.near_duplicates(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices that every text holds.

    Cases: see licenses; null texts hold none, repeated rows match each.
    """
    return licenses.scan(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences.

    Cases: see packing; a null text is the separator alone, repeated rows are packed each.
    """
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has and loses, and the digest of what stays.

    Cases: see line_dedup; null texts are one empty line, rows without an id lose nothing.
    """
    done = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids every text has under the byte-level ranks, and digests of the ids and of the bytes decoded from them.

    Cases: see byte_bpe; null texts are empty and have no ids, repeated rows are encoded each.
    """
    return byte_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's four first whitened components, with the exact squared deviation from the mean.

    Cases: see whitening; vectors that are null or hold null or non-finite entries have no rows.
    """
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and that of its label.

    Cases: see vector_codes; vectors that are null or hold null or non-finite entries have no rows.
    """
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label").withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_toxicity, op4_exact_dedup, op5_pieces, op6_warc, op7_near_dedup, op8_licenses, op9_packing, op10_line_dedup, op11_byte_bpe, op12_whitening, op13_vector_codes)}

SQL = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
             v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) AS v,
                          min(page_id) OVER (PARTITION BY hex) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM v
    """,
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
             k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             m AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op8_licenses": licenses.sql(),
    "op13_vector_codes": vector_codes.sql(),
}
