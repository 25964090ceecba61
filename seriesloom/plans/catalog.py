"""Queries over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from . import chains, evaluation, files, histories, learning, matching, names, projections, relational, serving

QUERIES: dict = {**histories.QUERIES, **relational.QUERIES, **evaluation.QUERIES, **files.QUERIES, **projections.QUERIES, **learning.QUERIES, **matching.QUERIES, **names.QUERIES, **chains.QUERIES, **serving.QUERIES}
ORACLE_SQL: dict = {**histories.SQL, **relational.SQL, **evaluation.SQL, **files.SQL, **projections.SQL, **learning.SQL, **matching.SQL, **names.SQL, **chains.SQL, **serving.SQL}
FLAGSHIP = "rolling_form"
