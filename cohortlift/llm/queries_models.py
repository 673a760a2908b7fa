"""Registered queries of the operators that learn."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlift.llm.quality import quality_scores
from cohortlift.llm.registry import query, table
from cohortlift.llm.toxicity import fit, toxicity_scores
from cohortlift.llm.urls import judged


#: The host rules of the query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op2_toxicity_neighbours")
def op2_toxicity_neighbours(spark, sf_dir):
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity_scores(fit(docs, labels, held_out=remainder(5) == 0))
    return scores.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query("op1_quality_discriminant")
def op1_quality_discriminant(spark, sf_dir):
    """Quality of every document, learnt from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_scores(docs, labels, held_out=remainder(4) == 2)
    return scores.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    """Every page's URL judged by the rules and, where none fits, by the character models."""
    return judged(table(spark, sf_dir, "pages"), URL_RULES)
