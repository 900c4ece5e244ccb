"""All registered queries."""

import importlib

from .registry import QUERIES, SQL

MODULES = ("listings", "voxels", "similarity", "anatomy", "cohorts")
for _name in MODULES:
    importlib.import_module(f".{_name}", __name__)
