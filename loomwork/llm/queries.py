"""The operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .common import table


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_digests, read_archives, write_archives

    return page_digests(read_archives(write_archives(table(spark, sf_dir, "pages"))))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .edit_counts import edited_counts

    return edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), 100)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"), width=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_license_scan, op3_hilbert_neighbours, op4_warc, op5_exact_dedup, op6_edit_counts, op7_byte_bpe, op8_toxicity, op9_packing, op10_suffix_dedup)}

SQL = {
    "op2_license_scan": licenses.sql(),
    "op1_minhash_near_dedup": """
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS MATERIALIZED (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[k : k + 3], ' ') for k in range(1, len(w) - 2)])
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), component AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM component LEFT JOIN sizes USING (doc_id)
    """,
    "op4_warc": """
        WITH own AS (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
        ), hashed AS (SELECT *, [CAST('0x' || substr(sha1(p), 5 * k + 1, 5) AS INTEGER) for k in range(8)] AS five FROM own)
        SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
               array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * j)) & 31) + 1, 1) for j in range(4)], '') for v in five], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM hashed
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
