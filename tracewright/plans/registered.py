"""All registered queries and their SQL."""

from tracewright.plans import catalog, files  # noqa: F401  files adds its own

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
