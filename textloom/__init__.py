"""Grammar-based text extraction on Spark."""

from .operators.extract import Query, compile, compile_unchecked
from .plans.diagnostics import Problem, QueryError, RunError

__all__ = ["Problem", "Query", "QueryError", "RunError", "compile", "compile_unchecked"]
