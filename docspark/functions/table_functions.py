"""The decoders as table functions for SQL text (2.14): ``SELECT t.* FROM archives, LATERAL help_table(path, content, 'fonts') t``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from docspark.functions.text import FORMATS
from docspark.sources import help_source


@udtf
class HelpTable:
    """``help_table(path, content, table[, version])``: the rows of one decoded table of an archive, with ``file`` and ``_error``.

    The table's name is a literal and decides the columns. Records and blocks are made by several passes and are no table function.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, table: AnalyzeArgument, version: AnalyzeArgument | None = None) -> AnalyzeResult:
        for argument in (table, version):
            if argument is not None and not argument.isConstantExpression:
                raise ValueError("the table and the version are literals")
        if table.value not in help_source.TABLES:
            raise ValueError(f"no table {table.value!r}; there are {', '.join(help_source.TABLES)}")
        if version is not None and version.value not in FORMATS:
            raise ValueError(f"no version {version.value!r}; there are {', '.join(FORMATS)}")
        return AnalyzeResult(help_source.schema_of(table.value))

    def eval(self, path: str, content: bytes, table: str, version: str | None = None) -> Iterator[tuple]:
        yield from help_source.rows_of(path, content, table, FORMATS[version] if version else None)


def register(spark: SparkSession) -> None:
    """Make ``help_table`` known to SQL."""
    spark.udtf.register("help_table", HelpTable)
