"""All registered queries of the library and their SQL."""

from recollect.plans import explore, extras, lifecycle, retrieval, support

MODULES = (support, explore, retrieval, lifecycle, extras)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
