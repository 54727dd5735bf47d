"""All queries of the library's own operators."""

from tidemill.plans import queries_business, queries_customer, queries_enrich, queries_fraud, queries_geo, queries_joins, queries_marketing, queries_models, queries_quality, queries_reports, queries_streaming  # noqa: F401
from tidemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
