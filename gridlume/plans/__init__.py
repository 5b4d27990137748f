"""Registered queries: importing the modules fills the registry."""

from gridlume.plans import module_queries, raster_queries, response_queries, scalar_queries, table_queries  # noqa: F401
from gridlume.plans.registry import QUERIES, SQL  # noqa: F401
