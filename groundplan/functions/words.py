"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as Unicode text handling knows it: as characters, as a pattern, and without line ends
SPACE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = r"(?U)[\s\x1c-\x1f]+"
GAP = r"[\s\x1c-\x1f&&[^\n]]"


def contains_any(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in dict.fromkeys(words)])


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """The whitespace separated words of ``text``."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without building a list of them element by element."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES)))


def days_between(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down."""
    seconds = end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")
    return F.floor(seconds / 86400).cast("int")


def label(value: Column, steps: list[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """Name of the first step that ``value`` reaches (passes, when ``strict``)."""
    chain = None
    for limit, name in steps:
        test = value > limit if strict else value >= limit
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(other)


def listed(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, name) for test, name in pairs]))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    An expression named inside a lambda is otherwise computed anew for every
    element the lambda sees.
    """
    return F.transform(F.array(value), use)[0]


def places(fields: Column) -> Column:
    """The place of each field, from 1; of a repeated one the last."""
    numbers = F.filter(F.sequence(F.lit(1), F.greatest(F.size(fields), F.lit(1))), lambda i: (i <= F.size(fields)) & ~F.array_contains(F.slice(fields, i + 1, F.size(fields)), F.get(fields, i - 1)))
    return F.map_from_entries(F.transform(numbers, lambda i: F.struct(F.get(fields, i - 1), i)))
