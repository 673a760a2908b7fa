"""A cleaning pipeline over ``documents``: each stage works on all that its predecessor kept.

toxicity -> line dedup -> MinHash near-dedup -> benchmark decontamination -> BPE tokens

Every stage takes and returns the columns of ``documents`` and is written as Parquet before the
next one reads it; the last returns a row of token figures for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlift.llm.bpe import encoding_digest
from cohortlift.llm.linededup import has_words, without_repeats
from cohortlift.llm.neardup import near_duplicates
from cohortlift.llm.registry import table
from cohortlift.llm.suffix import decontaminated
from cohortlift.llm.toxicity import fit, not_toxic
from cohortlift.sources.tables import staged


def drop_toxic(spark, docs, sf_dir):
    """Documents scored below one half by their nearest labelled examples stay. All labelled rows
    are learnt from."""
    return not_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_passages(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut out; a document of which nothing but blanks
    and signs is left goes, one that was like that before stays. n_chars follows the text."""
    cut = without_repeats(docs)
    left = cut.where((F.col("removed_words") == 0) | has_words("text"))
    columns = [
        F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars"
        else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return left.select(*columns)


def one_of_each_group(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    groups = near_duplicates(docs, shingle=5, percent=80)
    copies = groups.where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark, docs, sf_dir):
    """Token count and digests of ids and decoded text of each document."""
    return encoding_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_passages),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_tokens", token_digests),
]
#: SQL has neither the learnt scores nor the token merges; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
