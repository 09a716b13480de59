"""Plain SQL that states what each query has to return, written for DuckDB."""

from oracles.statements import statements

__all__ = ["statements"]
