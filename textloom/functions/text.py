"""Scalar text semantics shared by all operators, as Column expressions.

White space is Unicode white space plus U+001C..U+001F, as the strip() and split() of dynamic languages have it; Java's
\\s alone is ASCII. All case-insensitive patterns carry (?iu), all word boundaries (?U).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: Java looks single characters below U+0100 up in a table; every range or character beyond costs calls for each character of
#: a text, so that classes list their characters where they can.
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85]"
WIDE_LINE_END = LINE_END[:-1] + "\u2028\u2029]"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters of SPACE, for functions that take a set.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body is a nested lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pstrip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){SPACE}+$", "")


def squeeze(x: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(x, rf"(?U){SPACE}+", " ")


def newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def collapse(x: Column) -> Column:
    """At most one blank line in a row; the ends stripped."""
    return pstrip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def words(x: Column) -> Column:
    return F.array_remove(F.split(x, rf"(?U){SPACE}+"), F.lit(""))


def lines(x: Column) -> Column:
    """Lines by every line end that text files know; a last empty line is none."""
    unified = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    split = lambda u: F.split(u, F.when(u.contains("\u2028") | u.contains("\u2029"), WIDE_LINE_END).otherwise(LINE_END))
    return let(let(unified, split), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def at(array: Column, i: Column) -> Column:
    """Element i from 0, null outside."""
    return F.when(i >= 0, F.get(array, i))


def uniform(*keys: Column | str) -> Column:
    """Number in [0, 1) from the keys alone, so that draws do not depend on partitioning."""
    joined = F.concat_ws(":", *[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def runs(sorted_array: Column) -> Column:
    """Lengths of the runs of equal elements of a sorted array."""

    def starts(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != at(s, i - 1)))
        return let(first, lambda p: F.transform(p, lambda x, k: F.coalesce(F.get(p, k + 1), F.size(s)) - x))

    return let(sorted_array, lambda s: F.when(F.size(s) > 0, starts(s)).otherwise(F.array().cast("array<int>")))
