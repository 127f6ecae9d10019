"""The reStructuredText export (K1-K9, W5, W6, A5, A10) as a DataFrame of files, and its sink."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import text as t
from docspark.plans.help_file import HelpFiles, assemble
from docspark.sources import pictures, tree_sink

# Fixed value: the comment above pictures that stay metafiles.
WMF_NOTE = ".. WMF (Windows Metafile) — vector image saved unconverted; render to PNG/SVG to display in Sphinx HTML.\n"


def inline(run: Column) -> Column:
    """K4: one run; bold and italic nest, popups read like jumps."""
    plain = t.escape_markup(run["text"])
    italic = F.when(run["italic"], F.concat(F.lit("*"), plain, F.lit("*"))).otherwise(plain)
    styled = F.when(run["bold"], F.concat(F.lit("**"), italic, F.lit("**"))).otherwise(italic)
    link = F.concat(F.lit(":ref:`"), plain, F.lit(" <"), t.label(run["target"]), F.lit(">`"))
    return F.when(run["kind"] == "link", link).otherwise(styled)


def _marked(run: Column) -> Column:
    return (run["kind"] == "link") | run["bold"] | run["italic"]


def paragraph(runs: Column) -> Column:
    """The runs with a null escape between neighbouring markup; risky lines neutralised."""
    places = F.sequence(F.lit(1), F.size(runs))
    joined = F.transform(
        places,
        lambda i: F.concat(F.when((i > 1) & _marked(F.element_at(runs, i)) & _marked(F.element_at(runs, F.greatest(i - 1, F.lit(1)))), "\\ ").otherwise(""), inline(F.element_at(runs, i))),
    )
    lines = F.split(t.paragraph_start(F.array_join(joined, "")), "\n")
    return F.concat(F.array_join(F.transform(lines, t.neutral_line), "\n"), F.lit("\n"))


def picture(name: Column, placement: Column, kind: Column) -> Column:
    """An image or figure directive."""
    directive = F.when(placement == "inline", "image").otherwise("figure")
    align = F.when(placement == "inline", "").otherwise(F.concat(F.lit("   :align: "), placement, F.lit("\n")))
    note = F.when(kind == "wmf", WMF_NOTE).otherwise("")
    return F.concat(note, F.lit(".. "), directive, F.lit(":: _images/"), t.image_file(name, t.image_extension(kind)), F.lit("\n"), align, F.lit("\n"))


def cell(kind: Column, said: Column) -> Column:
    """a table cell: its text, a picture's name behind a bar, or a note for a table inside."""
    return F.when(kind == "image", F.concat(F.lit("|"), said)).when(kind == "table", "(nested table)").otherwise(said)


def table(rows: Column) -> Column:
    """A list table of already rendered cells (an array of arrays of strings)."""
    cells = F.flatten(F.transform(rows, lambda row: F.transform(row, lambda cell, i: F.concat(F.when(i == 0, "   * - ").otherwise("     - "), cell, F.lit("\n")))))
    return F.concat(F.lit(".. list-table::\n   :widths: auto\n\n"), F.array_join(cells, ""))


def _heading(title: Column) -> Column:
    return F.concat(title, F.lit("\n"), t.underline(title), F.lit("\n\n"))


def topic_files(found: HelpFiles) -> DataFrame:
    """K2: ``(file, path, content, ord)`` of every topic with an identifier."""
    formats = found.images.select("file", F.col("filename").alias("image"), F.col("format"))
    body = found.bodies.join(formats, ["file", "image"], "left")
    said = F.when(F.col("kind") == "image", picture(F.col("image"), F.col("placement"), F.col("format"))).otherwise(paragraph(F.col("inlines")))
    held = F.sort_array(F.collect_list(F.struct("rec_no", "block_no", F.concat(said, F.lit("\n")).alias("said"))))
    texts = body.groupBy("file", "topic_no").agg(F.array_join(F.transform(held, lambda x: x["said"]), "").alias("body"))
    named = found.topics.where("id <> ''").join(texts, ["file", "topic_no"], "left")
    index = F.when(F.size("keywords") > 0, F.concat(F.lit(".. index:: "), F.array_join("keywords", ", "), F.lit("\n\n"))).otherwise("")
    content = F.concat(F.lit(".. _"), t.label(F.col("id")), F.lit(":\n\n"), index, _heading(t.heading(F.col("title"), F.col("id"))), F.coalesce("body", F.lit("")))
    return named.select("file", F.concat(t.filename(F.col("id")), F.lit(".rst")).alias("path"), content.alias("content"), F.struct("topic_no", F.lit(-1).alias("alias_no")).alias("ord"))


def alias_files(found: HelpFiles) -> DataFrame:
    """K5, FL5: a stub for every alias that differs from its topic's identifier."""
    named = found.topics.where("id <> ''").select("file", "topic_no", "id", F.posexplode("aliases").alias("alias_no", "alias")).where("alias <> '' and alias <> id")
    primary = t.label(F.col("id"))
    content = F.concat(F.lit(":orphan:\n\n.. _"), t.label(F.col("alias")), F.lit(":\n\n"), _heading(primary), F.lit("See :ref:`"), primary, F.lit("`.\n"))
    return named.select("file", F.concat(t.filename(F.col("alias")), F.lit(".rst")).alias("path"), content.alias("content"), F.struct("topic_no", "alias_no").alias("ord"))


def index_files(found: HelpFiles) -> DataFrame:
    """K6, A10: the table of contents in chain order."""
    entries = F.sort_array(F.collect_list(F.struct("topic_no", F.concat(F.lit("   "), t.filename(F.col("id")), F.lit("\n")).alias("said"))))
    listed = found.topics.where("id <> ''").groupBy("file").agg(F.array_join(F.transform(entries, lambda x: x["said"]), "").alias("toc"))
    joined = found.summary.join(listed, "file", "left")
    right = F.coalesce(F.concat("copyright", F.lit("\n\n")), F.lit(""))
    content = F.concat(_heading(F.col("title")), right, F.lit(".. toctree::\n   :maxdepth: 2\n   :caption: Contents\n\n"), F.coalesce("toc", F.lit("")), F.lit("\n"))
    return joined.select("file", F.lit("index.rst").alias("path"), content.alias("content"))


def conf_files(found: HelpFiles) -> DataFrame:
    """K7: the builder's configuration."""
    right = F.coalesce(F.concat(F.lit("copyright = "), t.python_string(F.col("copyright")), F.lit("\n")), F.lit(""))
    content = F.concat(
        F.lit("# Configuration file for the Sphinx documentation builder.\n\nproject = "), t.python_string(F.col("title")), F.lit("\n"), right,
        F.lit("extensions = []\nexclude_patterns = ['_build']\n\n"),
    )
    return found.summary.select("file", F.lit("conf.py").alias("path"), content.alias("content"))


def _with_png(images: DataFrame) -> DataFrame:
    """``images(file, filename, format, data)`` with the PNG of bitmaps that have one."""

    def run(batches):
        for batch in batches:
            png = [pictures.to_png(data) if kind == "bmp" else None for kind, data in zip(batch.column("format").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(png, pa.binary())], ["file", "filename", "format", "data", "png"])

    return images.select("file", "filename", "format", "data").mapInArrow(run, "file string, filename string, format string, data binary, png binary")


def image_files(found: HelpFiles) -> DataFrame:
    """K8: metafiles as they are, bitmaps as PNG, others raw under their stem."""
    own = _with_png(found.images)
    name = F.when(F.col("format") == "wmf", t.image_file(F.col("filename"), F.lit("wmf"))).when(F.col("png").isNotNull(), t.image_file(F.col("filename"), F.lit("png"))).otherwise(t.image_stem(F.col("filename")))
    return own.select("file", F.concat(F.lit("_images/"), name).alias("path"), F.coalesce("png", "data").alias("content"))


def files(found: HelpFiles) -> DataFrame:
    """``(file, path, content)`` of the whole export; of topics and stubs of one name the last stays."""
    pages = topic_files(found).unionByName(alias_files(found))
    last = pages.groupBy("file", "path").agg(F.max_by("content", "ord").alias("content"))
    every = last.unionByName(index_files(found)).unionByName(conf_files(found))
    return every.withColumn("content", F.encode("content", "UTF-8")).unionByName(image_files(found))


def summary(found: HelpFiles) -> DataFrame:
    """Written topics, aliases and pictures of every archive."""
    named = found.topics.where("id <> ''")
    stubs = F.size(F.filter("aliases", lambda a: (a != "") & (a != F.col("id"))))
    counts = named.groupBy("file").agg(F.count("*").alias("topics_written"), F.sum(stubs).alias("aliases_written"))
    shown = found.images.groupBy("file").agg(F.count("*").alias("images_written"))
    joined = found.summary.select("file").join(counts, "file", "left").join(shown, "file", "left")
    return joined.na.fill(0)


def progress(found: HelpFiles) -> DataFrame:
    """Every written topic's number and their total."""
    own = Window.partitionBy("file")
    named = found.topics.where("id <> ''")
    return named.select("file", F.row_number().over(own.orderBy("topic_no")).alias("i"), F.count("*").over(own).alias("n"), "id")


def write(exported: DataFrame, folder: str, root: str = "") -> None:
    """K1: write every file below ``folder``, each under its archive's path below ``root`` without the extension."""
    below = F.when(F.startswith("file", F.lit(root)), F.substring("file", F.lit(len(root) + 1), F.length("file"))).otherwise(F.col("file"))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(below, "^[a-z]+:", ""), r"\.[^./]*$", ""), "^/+", "")
    tree_sink.write(exported.select(F.concat(stem, F.lit("/"), "path").alias("path"), "content"), folder)


def main(arguments: list[str] | None = None) -> int:
    """The command line; what can be read is exported, what cannot is told, and makes the status 1."""
    parser = argparse.ArgumentParser(prog="docspark", description="Export help archives as reStructuredText.")
    parser.add_argument("input", help="an archive or a folder of archives")
    parser.add_argument("output", help="the folder to write to")
    parser.add_argument("-v", "--verbose", action="store_true", help="tell every topic")
    parser.add_argument("-n", "--dry-run", action="store_true", help="read and count only")
    parser.add_argument("--format-version", choices=sorted(t.FORMATS), help="read as this version of the format")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("docspark").getOrCreate()
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hlp,HLP}").load(chosen.input)
    found = assemble(archives, chosen.format_version)
    if chosen.verbose:
        for row in progress(found).orderBy("file", "i").toLocalIterator():
            print(f"[{row['i']}/{row['n']}] {row['id']}", file=sys.stderr)
    if not chosen.dry_run:
        place = Path(chosen.input)
        write(files(found), chosen.output, f"file:{place.resolve() if place.is_dir() else place.resolve().parent}" if "://" not in chosen.input else chosen.input)
    for row in summary(found).orderBy("file").toLocalIterator():
        print(f"{row['file']}: {row['topics_written']} topics, {row['aliases_written']} aliases, {row['images_written']} images")
    broken = 0
    for row in found.errors.groupBy("file", "message").agg(F.min("part").alias("part")).orderBy("file", "part").toLocalIterator():
        broken += 1
        print(f"{row['file']}: {row['part']}: {row['message']}", file=sys.stderr)
    return 1 if broken else 0


if __name__ == "__main__":
    sys.exit(main())
