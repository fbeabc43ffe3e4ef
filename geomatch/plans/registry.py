"""Registered queries of the reference operators, by name."""

from __future__ import annotations

from geomatch.plans import queries_ops, queries_scalar

QUERIES: dict = queries_scalar.Q | queries_ops.Q
ORACLES: dict = queries_scalar.SQL | queries_ops.SQL
