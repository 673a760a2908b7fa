"""All registered queries; importing a module registers its rows."""

from cohortlift.plans import (  # noqa: F401
    embedding_queries,
    evaluation_queries,
    model_queries,
    prep_queries,
    profile_queries,
    signal_queries,
)
from cohortlift.plans.registry import ORACLES, QUERIES  # noqa: F401

#: Minutes of model fits each, without a twin.
LONG = ("l4_boosted_trees", "l7_nested_logistic", "r3_family_correctors")
