"""Registered queries of the cleaning operators."""

from __future__ import annotations

from cohortlift.llm.linededup import without_repeats
from cohortlift.llm.neardup import near_duplicates
from cohortlift.llm.registry import query, table
from cohortlift.llm.secrets import secret_digest, secret_spans
from cohortlift.llm.suffix import benchmark_matches, hit_summary

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_sql(table_name: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all({FOLDED}, '{pattern}') AS w FROM {table_name}"


ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op3_benchmark_decontamination",
    f"""WITH d AS MATERIALIZED ({words_sql("documents", "doc_id", ALNUM_WORD)}),
    b AS ({words_sql("benchmark", "item_id", ALNUM_WORD)}),
    windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM
      (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM
      (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
    grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM
      (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows)
      WHERE len(w) >= k)),
    hits AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM grams JOIN windows USING (k, g)),
    covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits)
      GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
      (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op3_benchmark_decontamination(spark, sf_dir):
    """Words of every document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hit_summary(benchmark_matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


@query(
    "op10_minhash_near_duplicates",
    f"""WITH RECURSIVE d AS MATERIALIZED ({words_sql("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS g FROM
      (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM
      (SELECT *, least(3, len(w)) AS k FROM d WHERE len(w) > 0))),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q
        ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id,
      doc_id <= coalesce(low.b, doc_id) AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id""",
)
def op10_minhash_near_duplicates(spark, sf_dir):
    """Components of documents whose three-word shingle sets are at least 0.85 similar."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query("op9_line_chunk_dedup")
def op9_line_chunk_dedup(spark, sf_dir):
    """Every document without the passages that an earlier document, or its own text, holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs)


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Secrets in every document: base patterns, and what the character models add."""
    return secret_digest(secret_spans(table(spark, sf_dir, "documents")))
