"""The engine in SQL: a table function ``extract(text, query)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.json_text import to_json
from ..plans.diagnostics import RunError


@udtf(returnType="value string, code string, message string")
class Extract:
    """One row a text: the result as JSON text, or the code and message of the failure."""

    def __init__(self):
        self.queries: dict = {}

    def eval(self, text: str, query: str):
        from .extract import compile

        if text is None:
            return
        if query not in self.queries:
            self.queries[query] = compile(query)
        try:
            yield to_json(self.queries[query].run(text).value), None, None
        except RunError as error:
            yield None, error.code, error.problems[0].message


def register(spark: SparkSession, name: str = "extract") -> None:
    """Afterwards: ``SELECT d.id, e.value FROM docs d, LATERAL extract(d.text, 'TEXT = ...') e``."""
    spark.udtf.register(name, Extract)
