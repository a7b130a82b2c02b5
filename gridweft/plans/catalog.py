"""All registered queries."""

from gridweft.plans import (  # noqa: F401
    catalog_annotations,
    catalog_evaluation,
    catalog_files,
    catalog_tables,
    catalog_text,
)
from gridweft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
