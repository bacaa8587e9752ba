"""Column functions for bibliographic text: JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A plain decimal number as double, else null: no thousands separators,
    type suffixes or NaN."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(_NUMBER), s.cast("double"))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def authors(c: Column, separator: str = ",") -> Column:
    """Stripped author names; a trailing separator yields an empty name."""
    return F.transform(F.split(c, separator), strip)


def references(c: Column) -> Column:
    """Cleaned references, duplicates kept: parts between semicolons that
    have a letter and a space, or look like a DOI or a work id."""

    def keep(x):
        low = F.lower(x)
        return (x.rlike(r"\p{L}") & F.contains(x, F.lit(" "))) | F.startswith(low, F.lit("10.")) | F.contains(low, F.lit("doi.org")) | F.startswith(low, F.lit("w"))

    return F.filter(F.transform(F.split(c, ";"), strip), lambda x: (x != "") & keep(x))


def doi(c: Column) -> Column:
    """A DOI without resolver or scheme prefix."""
    return F.replace(F.replace(strip(c), F.lit("https://doi.org/"), F.lit("")), F.lit("doi:"), F.lit(""))


def orange(value: Column, most: Column) -> Column:
    """rgb() text that darkens as value nears most (0 where most is 0)."""
    n = F.when(most != 0, value / most).otherwise(0.0)
    return F.concat(F.lit("rgb(255, "), (200 - 100 * n).cast("int").cast("string"), F.lit(", "), (100 * (1 - n)).cast("int").cast("string"), F.lit(")"))


def year_in(c: Column) -> Column:
    """The first 19xx or 20xx in a text."""
    found = F.regexp_extract(c, r"(19|20)\d{2}", 0)
    return F.when(found != "", found.cast("int"))


def author_names(authorships: Column) -> Column:
    """Display names of an authorship list joined by ', ', null if none."""
    names = F.filter(F.transform(authorships, lambda a: a["author"]["display_name"]), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def work_ids(works: Column) -> Column:
    """Work URLs as short ids joined by '; ', null if none."""
    ids = F.transform(works, lambda x: F.replace(x, F.lit("https://openalex.org/"), F.lit("")))
    return F.when(F.size(ids) > 0, F.array_join(ids, "; "))


def quoted(c: Column) -> Column:
    """A text for a URL's query: UTF-8 bytes in per cent, spaces as +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
