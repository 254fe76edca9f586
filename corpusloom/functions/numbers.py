"""Numbers of a text, in a form that can be compared, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import NUMBER
from .text import let, text_of

EMPTY = "cast(array() as array<string>)"


def join_split_thousands(c: Column) -> Column:
    """``48. 000`` becomes ``48.000``: a dot and a blank between a digit and exactly three digits."""
    return F.regexp_replace(text_of(c), r"(?<=[0-9])\. (?=[0-9]{3}(?![0-9]))", ".")


def numbers_in(c: Column) -> Column:
    return F.regexp_extract_all(join_split_thousands(c), F.lit(f"({NUMBER})"), F.lit(1))


def canonical_number(c: Column) -> Column:
    """Hyphened dates get slashes, thousands lose their marks, decimal commas become dots."""
    return (
        F.when(c.rlike(r"^[0-9]{1,2}-[0-9]{1,2}(-[0-9]{4})?$"), F.replace(c, F.lit("-"), F.lit("/")))
        .when(c.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"), F.regexp_replace(c, "[.,]", ""))
        .when(c.rlike(r"^[0-9]+[.,][0-9]+$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(c))


def number_parts(c: Column) -> Column:
    """What else a source's number vouches for: ends of a range, day/month and year of a date, year of a month."""
    pieces = F.concat(F.split(c, "-"), F.when(c.rlike(r"^[0-9]{1,2}-[0-9]{1,2}(-[0-9]{4})?$"), F.array(canonical_number(c))).otherwise(F.expr(EMPTY)))
    date, month = r"^([0-9]{1,2}/[0-9]{1,2})/([0-9]{4})$", r"^[0-9]{1,2}/([0-9]{4})$"
    each = F.transform(pieces, lambda p: F.filter(F.array(
        canonical_number(p), F.regexp_extract(p, date, 1), F.regexp_extract(p, date, 2), F.regexp_extract(p, month, 1)), lambda x: x != ""))
    return F.array_distinct(F.flatten(each))


def known_numbers(source: Column) -> Column:
    return let(numbers_in(source), lambda n: F.array_distinct(F.concat(F.transform(n, canonical_number), F.flatten(F.transform(n, number_parts)))))


def unsupported_numbers(text: Column, source: Column) -> Column:
    """Numbers of the text, in order and each once, that the source does not vouch for."""
    return let(known_numbers(source), lambda known: F.filter(F.array_distinct(numbers_in(text)), lambda n: ~F.array_contains(known, canonical_number(n))))
