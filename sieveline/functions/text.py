"""Source lines, names, paths and sentences, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_loc(text: Column) -> Column:
    """Lines that are neither blank, nor delimiters alone, nor comments. A fold over lines carries whether a block comment is open.

    A line that starts with `*` or `//` is a comment, as is all of a line that opens or closes a block comment at its
    start; a block comment that opens within a line isn't entered.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside"))

    def step(a: Column, line: Column) -> Column:
        bare = F.trim(line)
        opens, closes = bare.startswith("/*"), bare.contains("*/")
        comment = a["inside"] | opens | bare.startswith("//") | bare.startswith("*")
        counts = ~comment & ~bare.rlike("^[{}();,]*$")
        inside = F.when(a["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct((a["n"] + counts.cast("long")).alias("n"), inside.alias("inside"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: a["n"])


#: Fixed value: the most lines that are read around a finding.
MOST_LINES = 400


def source_range(text: Column, start: Column, end: Column, most: int = MOST_LINES) -> Column:
    """start_line, end_line, truncated and lines of a range (from 1, both ends in), at most `most` lines; a range that ends before it starts is null."""
    split = F.split(text, "\r\n|\r|\n")
    lines = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    n = F.size(lines)
    first = F.least(start, n).cast("int")
    last = F.least(end, first + most - 1, n).cast("int")
    read = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))))
    return F.when(end >= start, F.struct(first.alias("start_line"), last.alias("end_line"), (last < F.least(end, n)).alias("truncated"), read.alias("lines")))


def normalised_path(path: Column) -> Column:
    """Backslashes become slashes; slashes at the ends go."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def simple_name(code_name: Column) -> Column:
    """The last part of `package.Class` or the method of `package.Class#method T1 T2`."""
    method = F.regexp_extract(code_name, "#([^ ]+)", 1)
    return F.when(code_name.contains("#"), method).otherwise(F.element_at(F.split(code_name, "\\."), -1))


def owner_name(repository: Column) -> Column:
    """`owner/name` of `git@host:owner/name.git` or of a URL."""
    return F.regexp_extract(repository, "[:/]([^/:]+/[^/]+?)(?:\\.git)?/?$", 1)


def fingerprint(*parts: Column) -> Column:
    """32 hex digits that name a finding without its line or file."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256), 1, 32)


def suppressed(lines: Column, line: Column, smell_type: Column, marker: str = "smell:ignore") -> Column:
    """Whether a comment block right above a 1-based line carries the marker, for all types or with this one named in brackets.

    Blank lines are passed over, however many; the first line that is no comment ends the block.
    """
    before = F.reverse(F.slice(lines, F.lit(1), line - 1))
    start = F.struct(F.lit(False).alias("found"), F.lit(False).alias("stopped"))

    def step(a: Column, text: Column) -> Column:
        bare = F.trim(text)
        comment = bare.startswith("//") | bare.startswith("*") | bare.startswith("/*")
        names = F.regexp_extract(bare, f"{marker}(?:\\(([^)]*)\\))?", 1)
        hit = bare.contains(marker) & ((names == "") | F.array_contains(F.transform(F.split(names, ","), lambda x: F.trim(x)), smell_type))
        return F.struct((a["found"] | (~a["stopped"] & comment & hit)).alias("found"), (a["stopped"] | ~(comment | (bare == ""))).alias("stopped"))

    return F.aggregate(before, start, step, lambda a: a["found"])


def suppressed_by_annotation(lines: Column, line: Column, smell_type: Column, marker: str = "smell", most: int = 20) -> Column:
    """Whether the declaration at a 1-based line, up to the line of its first brace, has the marker (alone or with this type) in @SuppressWarnings."""
    header = F.regexp_extract(F.array_join(F.slice(lines, line, F.lit(most)), "\n"), "^([^{]*(?:\\{[^\n]*)?)", 1)
    names = F.regexp_extract_all(F.regexp_extract(header, "@SuppressWarnings\\s*\\(([^)]*)\\)", 1), F.lit('"([^"]*)"'), 1)
    return F.exists(names, lambda x: (x == marker) | (x == F.concat(F.lit(f"{marker}:"), smell_type)))


def sentences(text: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space."""
    return F.filter(F.transform(F.split(text, "[.!?][ \\n\\t]+"), lambda x: F.trim(x)), lambda x: x != "")


def grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
