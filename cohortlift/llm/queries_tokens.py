"""Registered queries of the token operators."""

from __future__ import annotations

from cohortlift.llm.bpe import encoding_digest
from cohortlift.llm.registry import query, table
from cohortlift.llm.tokencount import token_counts


@query("op5_bpe_encode_decode")
def op5_bpe_encode_decode(spark, sf_dir):
    """Encode and decode every document with the word-level vocabulary."""
    return encoding_digest(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """Tokens of every document in the byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"))
