"""Registered queries of the corpus operators, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.common import read
from keytide.llm.decontaminate import contamination
from keytide.llm.fill_middle import fill_in_middle, restored
from keytide.llm.html_text import extract_text
from keytide.llm.jaccard import jaccard_join
from keytide.llm.licenses import find_licenses
from keytide.llm.packing import pack
from keytide.llm.quality_model import quality_scores
from keytide.llm.quality_rules import quality_rules
from keytide.llm.ranked_search import ranked_search
from keytide.llm.secrets import find_secrets
from keytide.llm.token_counts import token_counts
from keytide.llm.toxicity import toxicity
from keytide.llm.warc import round_trip

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return round_trip(read(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found by the patterns and the character network."""
    return find_secrets(read(spark, sf_dir, "documents")).drop("n_model")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by the random field, with the offending spans."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by the hashed n-gram model."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    found = jaccard_join(read(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-piece tokens of each document."""
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the verdict of rules and forest."""
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract_text(read(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that each document names or holds."""
    return find_licenses(read(spark, sf_dir, "documents")).drop("matches")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in their forms, and what the forms are restored to, as digests."""
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    made = made.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    again = restored(F.col("form"), F.col("output"))
    return made.withColumn("restored_sha256", F.sha2(again.cast("binary"), 256)).drop("output")


_ALL = (
    op1_warc_round_trip,
    op2_secret_scan,
    op3_toxicity,
    op4_quality_classifier,
    op5_jaccard_join,
    op6_token_counts,
    op7_best_fit_packing,
    op8_benchmark_decontamination,
    op9_quality_rules,
    op10_html_extraction,
    op11_license_scan,
    op12_ranked_search,
    op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

SQL = {
    "op1_warc_round_trip": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), q AS (
            SELECT page_id, n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS latest FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < latest THEN latest END AS refers_to
        FROM q
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN []::VARCHAR[]
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
            FROM words
        ), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b USING (t)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id
        FROM sets s
    """,
    "op8_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
        ), items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ')
                FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS t FROM items WHERE len(w) > 0
        ), runs AS (
            SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM windows)
            WHERE len(w) >= n
        ), hits AS (
            SELECT doc_id, i, r.n, item FROM runs r JOIN windows x ON r.n = x.n
                AND array_to_string(r.w[r.i:r.i + r.n - 1], ' ') = x.t
        ), places AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
        ), found AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
            FROM hits GROUP BY 1
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op12_ranked_search": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), corpus AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
        q AS (
            SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark
        ), asked AS (SELECT item_id, t, count(*) AS repeats FROM q GROUP BY ALL),
        found AS (
            SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL
        ), weighted AS (
            SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
            FROM found, corpus GROUP BY t, docs
        ), scored AS (
            SELECT item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) //
                (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
            FROM asked JOIN found USING (t) JOIN weighted USING (t), corpus GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), drawn AS (
            SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
                t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
                ('0x' || h[25:32])::BIGINT % 100 < 20 AS spm FROM d
        ), cut AS (
            SELECT *, left(t, least(a, b)) AS p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
                substring(t, greatest(a, b) + 1) AS s FROM drawn
        )
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN NOT plain THEN least(a, b) END AS prefix_chars,
            CASE WHEN NOT plain THEN greatest(a, b) - least(a, b) END AS middle_chars,
            sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m
                ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut
    """,
}
