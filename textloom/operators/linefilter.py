"""Line filter of generated or scraped sections. Every step is an expression over one row's lines: nothing is shuffled.

Defined results: a null text or array of lines is an empty one, null lines are dropped; an empty text stays empty. These are
columns: repeated rows, other columns and empty tables are as the caller's query has them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import LETTERS, at, let, lines, pstrip, squeeze, words

LATIN, CYRILLIC = f"[{LETTERS}]", "[А-яЁё]"
OPEN_TAG, CLOSE_TAG = r"(?U)^[\s\x1c-\x1f]*<([A-Z]+)([^>]*)>[\s\x1c-\x1f]*$", r"(?U)^[\s\x1c-\x1f]*</([A-Z]+)>[\s\x1c-\x1f]*$"
#: Neighbouring letters of two scripts within a word, and the broken word form with its right spelling.
MIXED = f"{LATIN}[0123456789_-]*{CYRILLIC}|{CYRILLIC}[0123456789_-]*{LATIN}"
BROKEN_FORM, RIGHT_FORM = "по-преж", "по-прежнему"


@dataclass(frozen=True)
class FilterConfig:
    """Folded into literals when the plan is built."""

    min_words_per_line: int = 3
    max_same_line_repeats: int = 2
    drop_latin_lines: bool = True
    drop_mixed_cyr_lat_words: bool = True
    keep_tag_lines: bool = True
    collapse_whitespace: bool = True


def is_open_tag(line: Column) -> Column:
    return line.contains("<") & F.regexp_like(line, F.lit(OPEN_TAG))


def is_close_tag(line: Column) -> Column:
    return line.contains("</") & F.regexp_like(line, F.lit(CLOSE_TAG))


def is_tag_line(line: Column) -> Column:
    return is_open_tag(line) | is_close_tag(line)


def has_latin(line: Column) -> Column:
    return F.regexp_like(line, F.lit(LATIN))


def may_have_cyrillic(x: Column) -> Column:
    """Whether a byte of the text leads a character of U+0400 to U+047F; patterns beyond Latin cost far more."""
    led = [F.contains(x.cast("binary"), F.lit(bytearray([b]))) for b in (0xD0, 0xD1)]
    return led[0] | led[1]


def has_mixed_word(line: Column) -> Column:
    """A word with letters of both scripts: two letters, one of each, with nothing but other word characters between them."""
    return may_have_cyrillic(line) & F.regexp_like(line, F.lit(CYRILLIC)) & F.regexp_like(line, F.lit(LATIN)) & F.regexp_like(line, F.lit(MIXED))


def has_broken_form(line: Column) -> Column:
    return line.contains(BROKEN_FORM) & ~line.contains(RIGHT_FORM)


def cap_repeats(kept: Column, most: int, keep_tags: bool = True) -> Column:
    """Of a run of equal lines the first max(1, most); tag lines always stay and break runs."""
    most = max(1, most)

    def stays(kept: Column) -> Column:
        repeated = lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(at(kept, i - k) == x, F.lit(False)) for k in range(1, most + 1)])
        return F.filter(kept, lambda x, i: (is_tag_line(x) if keep_tags else F.lit(False)) | ~repeated(x, i))

    return let(kept, stays)


def clean_lines(raw: Column, config: FilterConfig = FilterConfig()) -> Column:
    """Array of lines -> array of cleaned lines."""
    stripped = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), pstrip), lambda x: x != "")
    if config.collapse_whitespace:
        stripped = F.transform(stripped, squeeze)

    def passes(x: Column) -> Column:
        n_words = F.size(F.split(x, " ") if config.collapse_whitespace else words(x))
        good = ~has_broken_form(x) & (n_words >= config.min_words_per_line)
        if config.drop_latin_lines:
            good = ~has_latin(x) & good
        elif config.drop_mixed_cyr_lat_words:  # no such word is left where lines with Latin letters go
            good = ~has_mixed_word(x) & good
        return (is_tag_line(x) | good) if config.keep_tag_lines else good

    return cap_repeats(F.filter(stripped, passes), config.max_same_line_repeats, config.keep_tag_lines)


def extract_tagged_block(text: Column) -> Column:
    """struct<tag, open_line, close_line>: the first opening and the last closing tag line, empty strings where missing."""
    return _tagged_block(lines(text))


def _tagged_block(all_lines: Column) -> Column:
    def of(tags: Column) -> Column:
        first = F.coalesce(F.get(F.filter(tags, is_open_tag), F.lit(0)), F.lit(""))
        last = F.coalesce(F.try_element_at(F.filter(tags, is_close_tag), F.lit(-1)), F.lit(""))
        return F.struct(F.regexp_extract(first, OPEN_TAG, 1).alias("tag"), first.alias("open_line"), last.alias("close_line"))

    return let(F.transform(F.filter(all_lines, lambda x: x.contains("<")), pstrip), of)


def clean_section_text(text: Column, config: FilterConfig = FilterConfig()) -> Column:
    """Cleaned text; where the section had an opening tag, tags that are missing at the ends are put back."""

    def restored(raw: Column, cleaned: Column) -> Column:
        def with_tags(block: Column) -> Column:
            opened = F.when(F.coalesce(is_open_tag(F.get(cleaned, F.lit(0))), F.lit(False)), cleaned).otherwise(F.concat(F.array(block["open_line"]), cleaned))
            closed = let(opened, lambda o: F.when(F.coalesce(is_close_tag(F.try_element_at(o, F.lit(-1))), F.lit(False)), o).otherwise(F.concat(o, F.array(block["close_line"]))))
            return F.when(block["tag"] != "", closed).otherwise(cleaned)

        return let(_tagged_block(raw), with_tags)

    # The text may be an expression of any cost: it is split once for both.
    kept = let(lines(F.coalesce(text, F.lit(""))), lambda raw: let(clean_lines(raw, config), lambda cleaned: restored(raw, cleaned)))
    return pstrip(F.array_join(kept, "\n"))
