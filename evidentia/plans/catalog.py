"""All queries on the driver's tables, and their SQL."""

from __future__ import annotations

from . import assets, evaluation, search, timeline, training

QUERIES = timeline.QUERIES | search.QUERIES | evaluation.QUERIES | training.QUERIES | assets.QUERIES
ORACLE = timeline.ORACLE | search.ORACLE | evaluation.ORACLE | training.ORACLE | assets.ORACLE
