"""Archives decoded as they arrive in a folder; one archive is decoded on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.sources import help_source

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, table: str, format_version: str | None = None) -> DataFrame:
    """``table`` of every archive that appears in ``folder``, as a stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{hlp,HLP}").load(folder)
    return help_source.decode(files, table, format_version)
