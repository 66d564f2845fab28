"""Songs as marked sections: headers, speakers, cleaning, and the voice that a song mostly has.

Defined results: a null or blank text has no sections, the empty clean text and the group as its voice; a header without
speaker is the group's; of equally long voices the first counts; repeated rows are songs of their own; an empty table gives
no rows; columns that are not named are not kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import at, collapse, let, newlines, pstrip, squeeze

SECTION = "struct<type:string,index:int,speaker:string,text:string,order:int>"
HEADER = r"(?U)^\s*\[(.+?)\]\s*:?\s*$"
#: Section types by the word that begins a header, first match wins.
TYPES = {
    "VERSE": "куплет|verse",
    "CHORUS": "припев|chorus",
    "BRIDGE": "бридж|bridge",
    "INTRO": "интро|intro",
    "OUTRO": "аутро|outro",
    "REFRAIN": "рефрен|refrain",
    "HOOK": "хук|hook",
}
OTHER, GROUP, UNKNOWN = "OTHER", "group", "unknown"
#: Page litter, and the marker before which everything is description.
JUNK = r"(?iuU)^(\d+\s+contributors?\s*|read more\s*|you might also like\s*|.*\blyrics\b\s*)$"
MARKER = r"(?iuU)^\s*\[текст песни"
#: Punctuation that may stand alone on a broken line; an opening one is set off by a space.
PUNCTUATION = (",", ".", "—", "-", "…", ":", ";", "!", "?", ")", "(", "»", "«")
SPACED = ("(", "«")
#: Fixed value: longest word that may be the rest of a broken line.
FRAGMENT_LENGTH = 14


@dataclass(frozen=True)
class Markup:
    """What depends on the corpus: spellings of speakers (in order of precedence) and page litter."""

    speakers: Mapping[str, str] = field(default_factory=dict)
    junk: str = JUNK
    marker: str = MARKER


def section_type(left: Column) -> Column:
    text, out = F.lower(pstrip(left)), None
    for name, stems in TYPES.items():
        hit = F.regexp_like(text, F.lit(rf"(?iuU)^\s*({stems})\b"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def parse_header(header: Column) -> Column:
    """struct<type, index, speaker_raw> of a header's text."""

    def of(parts: Column) -> Column:
        left, right = pstrip(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
        number = F.nullif(F.regexp_extract(left, r"(?U)\b(\d+)\b", 1), F.lit(""))
        return F.struct(section_type(left).alias("type"), number.try_cast("int").alias("index"), pstrip(right).alias("speaker_raw"))

    return let(F.split(header, ":", 2), of)


def normalize_speaker(raw: Column, speakers: Mapping[str, str]) -> Column:
    """Canonical name of the first spelling that the raw name contains; an equal spelling is also a contained one."""
    s = F.regexp_replace(F.lower(pstrip(raw)), "ё", "е")
    s = squeeze(pstrip(F.regexp_replace(s, r"feat\.?|ft\.?", "")))
    out = F.when(raw.isNull() | (raw == ""), GROUP)
    exact = {k.replace("ё", "е"): v for k, v in reversed(list(speakers.items()))}
    for spelling, name in exact.items():
        out = out.when(s == spelling, name)
    for spelling, name in speakers.items():
        out = out.when(s.contains(spelling.replace("ё", "е")), name)
    return out.otherwise(GROUP)


def is_junk(line: Column, junk: str = JUNK) -> Column:
    return F.regexp_like(pstrip(line), F.lit(junk))


def is_header(line: Column) -> Column:
    return F.regexp_like(line, F.lit(HEADER))


def strip_pre_text(all_lines: Column, marker: str = MARKER) -> Column:
    """Lines from the first marker line on; all of them where there is none."""
    place = F.array_position(F.transform(all_lines, lambda x: F.regexp_like(x, F.lit(marker))), F.lit(True)).cast("int")
    return F.when(place > 0, F.slice(all_lines, place, F.size(all_lines))).otherwise(all_lines)


def song_lines(raw: Column, markup: Markup) -> Column:
    return let(F.transform(F.split(newlines(F.coalesce(raw, F.lit(""))), "\n"), pstrip), lambda x: strip_pre_text(x, markup.marker))


def stitch(text: Column) -> Column:
    """Opt-in: joins lines that are one short word or one punctuation mark to the line before them."""
    marks = F.array(*[F.lit(p) for p in PUNCTUATION])
    fragment = lambda x: (x != "") & (((F.length(x) <= FRAGMENT_LENGTH) & ~x.contains(" ")) | F.array_contains(marks, x))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.when(F.array_contains(marks, x) & ~x.isin(*SPACED), F.lit("")).otherwise(F.lit(" ")), x)
        joins = (F.size(acc) > 0) & fragment(x)
        return F.when(joins & (F.try_element_at(acc, F.lit(-1)) != ""), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    stripped = F.transform(F.split(text, "\n"), pstrip)
    return collapse(F.array_join(F.aggregate(stripped, F.array().cast("array<string>"), add), "\n"))


def clean_lyrics(raw: Column, markup: Markup = Markup(), stitched: bool = False) -> Column:
    """Text without description, headers and litter."""
    drop = lambda x: F.regexp_like(x, F.lit(markup.marker)) | is_header(x) | is_junk(x, markup.junk)
    text = collapse(F.array_join(F.filter(song_lines(raw, markup), lambda x: ~drop(x)), "\n"))
    return stitch(text) if stitched else text


def split_sections(raw: Column, markup: Markup = Markup(), stitched: bool = False) -> Column:
    """Raw text -> array of sections, by one pass over the row's own lines.

    A header of a known type begins a section; other bracket lines, markers and litter are dropped and break nothing.
    Text before the first header is a section of type OTHER with the speaker `unknown`. Empty sections are dropped.
    """

    def of(all_lines: Column) -> Column:
        real = lambda x: is_header(x) & (parse_header(F.regexp_extract(x, HEADER, 1))["type"] != OTHER)
        heads = F.filter(F.transform(all_lines, lambda x, i: F.when(real(x), i)), lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(-1)), heads), lambda h: F.transform(h, lambda start, k: section(all_lines, start, F.coalesce(F.get(h, k + 1), F.size(all_lines)))))

    def section(all_lines: Column, start: Column, end: Column) -> Column:
        body = F.slice(all_lines, start + 2, F.greatest(F.lit(0), end - start - 1))
        drop = lambda x: F.regexp_like(x, F.lit(markup.marker)) | is_header(x) | is_junk(x, markup.junk)
        text = collapse(F.array_join(F.filter(body, lambda x: ~drop(x)), "\n"))
        head = parse_header(F.regexp_extract(at(all_lines, start), HEADER, 1))
        return F.struct(
            F.coalesce(head["type"], F.lit(OTHER)).alias("type"), head["index"].alias("index"),
            F.when(start < 0, UNKNOWN).otherwise(normalize_speaker(head["speaker_raw"], markup.speakers)).alias("speaker"),
            (stitch(text) if stitched else text).alias("text"),
        )

    kept = F.filter(let(song_lines(raw, markup), of), lambda s: s["text"] != "")
    ordered = F.transform(kept, lambda s, i: F.struct(s["type"].alias("type"), s["index"].alias("index"), s["speaker"].alias("speaker"), s["text"].alias("text"), i.cast("int").alias("order")))
    return ordered.cast(f"array<{SECTION}>")


def infer_single_speaker(sections: Column) -> Column:
    """If one speaker other than the group occurs, the group's sections are theirs."""

    def of(s: Column) -> Column:
        named = F.array_distinct(F.filter(F.transform(s, lambda x: x["speaker"]), lambda x: x != GROUP))
        return let(named, lambda n: F.when(F.size(n) == 1, F.transform(s, lambda x: x.withField("speaker", F.when(x["speaker"] == GROUP, F.get(n, F.lit(0))).otherwise(x["speaker"])))).otherwise(s))

    return let(sections, of)


def dominant_voice(sections: Column) -> Column:
    """Speaker with the longest text, the first of equal ones, `unknown` left aside; the group where none is left."""

    def of(s: Column) -> Column:
        known = F.filter(s, lambda x: (x["speaker"] != UNKNOWN) & (x["speaker"] != ""))
        names = F.array_distinct(F.transform(known, lambda x: x["speaker"]))
        total = lambda n: F.aggregate(F.filter(known, lambda x: x["speaker"] == n), F.lit(0), lambda a, x: a + F.length(x["text"]))
        ranked = F.transform(names, lambda n, i: F.struct(total(n).alias("n"), (-i).alias("i"), n.alias("name")))
        return F.coalesce(F.array_max(ranked)["name"], F.lit(GROUP))

    return let(sections, of)


def dominant_voice_by_rows(sections: DataFrame, song: str, speaker: str, text: str, order: str) -> DataFrame:
    """The same over one row per section: two aggregations with partial sums, no window."""
    known = sections.filter(F.col(speaker).isNotNull() & (F.col(speaker) != UNKNOWN) & (F.col(speaker) != ""))
    totals = known.groupBy(song, speaker).agg(F.sum(F.length(text)).alias("_n"), F.min(order).alias("_first"))
    named = totals.groupBy(song).agg(F.max_by(speaker, F.struct(F.col("_n"), -F.col("_first"))).alias("dominant_voice"))
    return sections.select(song).distinct().join(named, song, "left").select(song, F.coalesce("dominant_voice", F.lit(GROUP)).alias("dominant_voice"))


def mark_songs(songs: DataFrame, markup: Markup = Markup(), stitched: bool = False) -> DataFrame:
    """artist, title, url, lyrics -> artist, title, url, lyrics_clean, sections, dominant_voice."""
    found = songs.withColumn("sections", infer_single_speaker(split_sections(F.col("lyrics"), markup, stitched)))
    return found.select("artist", "title", "url", clean_lyrics(F.col("lyrics"), markup, stitched).alias("lyrics_clean"), "sections", dominant_voice(F.col("sections")).alias("dominant_voice"))
