"""All registered queries by name, and the SQL that gives the same rows."""

from meterflow.catalog import analysis, builds, business, foundation, operations  # noqa: F401
from meterflow.catalog.base import ORACLE_SQL, QUERIES

FLAGSHIP = "report_day"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
