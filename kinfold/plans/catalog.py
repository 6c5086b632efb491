"""All registered queries."""

from kinfold.plans import (  # noqa: F401
    queries_annotation,
    queries_genotype,
    queries_io,
    queries_models,
    queries_phenotype,
    queries_results,
)
from kinfold.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
