"""Scalar functions over strings, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF

# Characters that a file name, a label and an image's stem may not hold.
FILENAME_CHARS = ' \\/:<>"|?*'
LABEL_CHARS = " \\/"
STEM_CHARS = '/\\:*?"<>|'
# Characters that reStructuredText gives a meaning.
MARKUP_CHARS = "\\*`|_"


def context_hash(name: Column) -> Column:
    """bytes folded by ``h * 43 + byte`` modulo 2^32, A-Z as a-z; 0 for the empty string.

    The bytes come from the hexadecimal form, two digits each, so that names of any script fold.
    """
    digits = F.hex(F.encode(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8"))
    count = F.octet_length(name)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: F.pmod(h * 43 + byte(i), F.lit(1 << 32)))


def context_name(value: Column) -> Column:
    """``ctx_`` and eight lower-case hexadecimal digits."""
    return F.concat(F.lit("ctx_"), F.lpad(F.lower(F.hex(value)), 8, "0"))


def unresolved_name(value: Column) -> Column:
    """``0x`` and eight upper-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), 8, "0"))


def bitmap_name(number: Column) -> Column:
    """the internal file of a numbered picture."""
    return F.concat(F.lit("|bm"), number.cast("string"))


def has_flag(attributes: Column, flag: int) -> Column:
    """bit tests; 1 bold, 2 italic, 4 underline."""
    return attributes.bitwiseAND(F.lit(flag)) != 0


def escape_markup(text: Column) -> Column:
    """a backslash before every markup character, backslashes included."""
    return F.regexp_replace(text, r"([\\*`|_])", r"\\$1")


def label(text: Column) -> Column:
    """a reference label."""
    return F.translate(text, LABEL_CHARS, "_" * len(LABEL_CHARS))


def filename(text: Column) -> Column:
    """F8: a file name."""
    return F.translate(text, FILENAME_CHARS, "_" * len(FILENAME_CHARS))


def image_stem(name: Column) -> Column:
    """a picture's name without its leading bar and with safe characters."""
    return F.translate(F.regexp_replace(name, r"^\|", ""), STEM_CHARS, "_" * len(STEM_CHARS))


def image_file(name: Column, extension: Column) -> Column:
    """the stem with its last extension replaced."""
    return F.concat(F.regexp_replace(image_stem(name), r"(?s)\.[^.]*$", ""), F.lit("."), extension)


def neutral_line(line: Column) -> Column:
    """a line that would read as a transition (four or more equal punctuation marks) gets a backslash."""
    return F.regexp_replace(line, r"(?U)^(\s*)(([!-/:-@\[-`{-~])\3{3,}\s*)$", r"$1\\$2")


def python_string(text: Column) -> Column:
    """a single-quoted Python literal."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit("'"), out, F.lit("'"))


def underline(title: Column) -> Column:
    """as many ``=`` as the title has bytes, one at least."""
    return F.repeat(F.lit("="), F.greatest(F.octet_length(title), F.lit(1)))


def title_or_default(title: Column) -> Column:
    """missing titles."""
    return F.coalesce(title, F.lit("(untitled)"))


def heading(title: Column, topic: Column) -> Column:
    """an empty title is replaced by the topic's identifier."""
    return F.when(title == "", topic).otherwise(title)


def id_or_default(topic: Column) -> Column:
    """missing identifiers."""
    return F.coalesce(topic, F.lit(""))


def image_extension(kind: Column) -> Column:
    """Pictures are PNG unless they are metafiles."""
    return F.when(kind == "wmf", "wmf").otherwise("png")


# Minor version and label of each format.
FORMATS = {"3.0": 15, "3.1": 21, "4.0": 27}


def minor_version(name: Column) -> Column:
    """the minor version of a format's label, null for others."""
    return F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[name]


def paragraph_start(text: Column) -> Column:
    """leading blanks and tabs removed."""
    return F.ltrim(text, F.lit(" \t"))


def split_style(text: Column) -> Column:
    """Leading white space, core and trailing white space of a styled run; white space alone is leading."""
    lead = F.regexp_extract(text, r"(?U)^(\s*)", 1)
    rest = F.regexp_replace(text, r"(?U)^\s+", "")
    tail = F.regexp_extract(rest, r"(?U)(\s*)$", 1)
    core = F.regexp_replace(rest, r"(?U)\s+$", "")
    return F.struct(lead.alias("lead"), core.alias("core"), tail.alias("tail"))


def until_nul(text: Column) -> Column:
    """The string before the first NUL."""
    return F.substring_index(text, "\0", 1)
