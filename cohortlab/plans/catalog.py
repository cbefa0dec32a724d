"""All registered queries."""

from cohortlab.plans import catalog_checks, catalog_ensemble, catalog_evidence, catalog_outcomes, catalog_rules, catalog_symptoms, catalog_trends  # noqa: F401
from cohortlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
