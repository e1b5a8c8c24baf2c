"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact_dedup, fertility, langid, mixing, packing, secrets, simhash, toxicity, warc, whitening


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine; the same on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents")).drop("locator")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_fertility, op3_bpe, op4_chat, op5_langid, op6_simhash, op7_warc, op8_mixing, op9_secrets, op10_exact_dedup,
        op11_whitening, op12_collocations, op13_packing,
    )
}

ORACLE_SQL = {
    "op12_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
        ), grams AS (
            SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS gram, m
            FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m)
        ), counted AS (
            SELECT lang, gram, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
        ), cuts AS (
            SELECT lang, gram, m, f AS a, unnest(range(1, m)) AS k, string_split(gram, ' ') AS w FROM counted WHERE m > 1
        ), parts AS (
            SELECT c.lang, c.gram, c.m, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000 * c.a::HUGEINT // (x.f::HUGEINT + y.f) AS BIGINT) AS score
            FROM cuts c
            JOIN counted x ON x.lang = c.lang AND x.gram = array_to_string(c.w[1:c.k], ' ')
            JOIN counted y ON y.lang = c.lang AND y.gram = array_to_string(c.w[c.k + 1:], ' ')
        ), scored AS (
            SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
        ), inside AS (
            SELECT DISTINCT s.lang, s.gram FROM scored s JOIN (
                SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda n: list_transform(range(1, m - n + 2), lambda i: array_to_string(string_split(gram, ' ')[i:i + n - 1], ' '))))) AS gram
                FROM counted WHERE m > 2
            ) longer ON longer.lang = s.lang AND longer.gram = s.gram AND 100 * longer.f::HUGEINT >= 80 * s.a::HUGEINT
        ), ranked AS (
            SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(gram)) AS rank
            FROM scored s ANTI JOIN inside USING (lang, gram)
        )
        SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), g AS (
            SELECT body, min(page_id) AS first_id FROM p GROUP BY body
        ), d AS (
            SELECT p.page_id, p.body, g.first_id, sha1(p.body) AS h FROM p JOIN g ON p.body = g.body
        )
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                    (CAST(('0x' || substr(h || '0', 1 + CAST(floor(i * 5 / 4) AS INTEGER), 2)) AS INTEGER)
                     >> (3 - CAST((i * 5) % 4 AS INTEGER))) & 31 AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM d
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        ), g AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
}
