"""Dictionary order: sort keys with language rules and with numbers by their value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a run's length; a run of more digits than this can say is taken as one of that many.
LENGTH_DIGITS = 4


def by_number(text: Column) -> Column:
    """The text with every run of ASCII digits led by its length, so that digit by digit comparison compares numbers.

    Leading zeros do not count. Other digits are compared one by one.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    led = lambda r: F.concat(F.lpad(F.length(bare(r)).cast("string"), LENGTH_DIGITS, "0"), bare(r))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), led(r)).otherwise(r)), "")


def dictionary(text: Column, numeric: bool = True, language: str = "en") -> Column:
    """A key that sorts as a dictionary of the language does: letters before case and accents, any script, numbers by value.

    A text that is null has a null key, an empty one sorts first. The key is a string with the language's collation, so
    it can stand in ORDER BY, in windows and in arrays of structs alike.
    """
    return F.collate(by_number(text) if numeric else text, language)
