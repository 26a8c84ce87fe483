"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from tidefold.queries import analytics, folds, reads  # noqa: F401  they register their queries
from tidefold.queries.base import ORACLE, QUERIES  # noqa: F401
