"""Plain Python forms of the line filter and of the scores, for loops inside a task: a song's next section depends on its last.

They give what linefilter.clean_section_text and scoring.score_in_context give, to the last bit of the score.
"""

from __future__ import annotations

import re
from collections import Counter

from textloom.operators.linefilter import BROKEN_FORM, CYRILLIC, LATIN, MIXED, RIGHT_FORM, FilterConfig

OPEN_TAG, CLOSE_TAG = re.compile(r"\s*<([A-Z]+)([^>]*)>\s*"), re.compile(r"\s*</([A-Z]+)>\s*")
_LATIN, _CYRILLIC, _MIXED = map(re.compile, (LATIN, CYRILLIC, MIXED))
#: As in scoring: words of an n-gram, and the score of a text without content.
N, NO_CONTENT = 4, -1e9


def is_tag_line(line: str) -> bool:
    return "<" in line and bool(OPEN_TAG.fullmatch(line) or CLOSE_TAG.fullmatch(line))


def clean_lines(raw: list[str], config: FilterConfig) -> list[str]:
    kept = []
    for line in raw:
        line = line.strip()
        if not line:
            continue
        words = line.split()
        if config.collapse_whitespace:
            line = " ".join(words)
        if not (config.keep_tag_lines and is_tag_line(line)):
            if config.drop_latin_lines:
                bad = _LATIN.search(line)
            else:
                bad = config.drop_mixed_cyr_lat_words and _MIXED.search(line)
            if bad or len(words) < config.min_words_per_line or (BROKEN_FORM in line and RIGHT_FORM not in line):
                continue
        kept.append(line)
    out, run = [], 0
    for i, line in enumerate(kept):
        run = run + 1 if i and kept[i - 1] == line else 0
        if run < max(1, config.max_same_line_repeats) or (config.keep_tag_lines and is_tag_line(line)):
            out.append(line)
    return out


def clean_section_text(text: str | None, config: FilterConfig) -> str:
    raw = (text or "").splitlines()
    cleaned = clean_lines(raw, config)
    tags = [x.strip() for x in raw if "<" in x]
    first = next((x for x in tags if OPEN_TAG.fullmatch(x)), None)
    if first is not None:
        if not cleaned or not OPEN_TAG.fullmatch(cleaned[0]):
            cleaned = [first, *cleaned]
        if not CLOSE_TAG.fullmatch(cleaned[-1]):
            cleaned = [*cleaned, next((x for x in reversed(tags) if CLOSE_TAG.fullmatch(x)), "")]
    return "\n".join(cleaned).strip()


def content_lines(text: str) -> list[str]:
    return [s for x in text.splitlines() if (s := x.strip()) and not is_tag_line(s)]


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*[words[k:] for k in range(N)], strict=False))


def context(text: str) -> tuple[set[str], set[tuple[str, ...]]]:
    """Lines and n-grams of a context."""
    content = content_lines(text)
    return set(content), set(_grams(" ".join(content).split()))


def score_in_context(text: str, before: tuple[set[str], set[tuple[str, ...]]]) -> float:
    content = content_lines(text)
    if not content:
        return NO_CONTENT
    joined = " ".join(content)
    words, counts = joined.split(), Counter(content)
    grams = _grams(words)
    distinct = set(grams)
    cyr, lat, often = len(_CYRILLIC.findall(joined)), len(_LATIN.findall(joined)), sorted(counts.values(), reverse=True)
    avg_words, uniq_ratio = len(words) / len(content), len(counts) / len(content)
    repetition = (len(grams) - len(distinct)) / max(1, len(grams))
    # The terms stand in the order of scoring's, so that sums round alike.
    score = (
        4.0 * cyr / max(1, cyr + lat) + 0.10 * len(content) + 0.20 * avg_words + 2.0 * uniq_ratio
        - 4.0 * max(0, often[0] - 2) - 0.8 * max(0, sum(often[:3]) - 8) - 3.5 * repetition
        - (5.0 if uniq_ratio < 0.4 else 0.0) - 2.0 * max(0.0, avg_words - 20) - (10.0 if lat > 0 else 0.0)
    )
    lines_before, grams_before = before
    share = lambda own, other: len(own & other) / len(own) if own else 0.0
    return score - (8.0 * share(counts.keys(), lines_before) + 6.0 * share(distinct, grams_before))
