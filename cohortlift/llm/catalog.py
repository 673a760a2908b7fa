"""All queries of the subpackage; importing a module registers its rows."""

from cohortlift.llm import queries_clean, queries_mix, queries_models, queries_search, queries_tokens  # noqa: F401
from cohortlift.llm.registry import ORACLES, QUERIES  # noqa: F401
