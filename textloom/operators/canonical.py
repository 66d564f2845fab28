"""Canonical markup of songs: tagged sections, the structure line, and the corpus and index projections.

Defined results: a null type is OTHER, a null speaker or voice the group, a null text empty, null sections none; missing and
null fields cannot be told apart in a table. Sections of one order and index keep their place; repeated rows are songs of
their own; an empty table gives no rows; columns that are not named are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import collapse, newlines, rstrip

#: Fixed value: order of a section that has none.
LAST = 1_000_000_000


def sanitize(text: Column) -> Column:
    trimmed = F.transform(F.split(newlines(F.coalesce(text, F.lit(""))), "\n"), rstrip)
    return collapse(F.array_join(trimmed, "\n"))


def sort_sections(sections: Column) -> Column:
    """By order (missing: last), then index (missing: last), then place."""
    key = lambda s, i: F.struct(F.coalesce(s["order"], F.lit(LAST)).alias("a"), s["index"].isNull().alias("b"), s["index"].alias("c"), i.alias("d"), s.alias("s"))
    return F.transform(F.array_sort(F.transform(sections, key)), lambda x: x["s"])


def section_label(s: Column) -> Column:
    kind, speaker = F.coalesce(s["type"], F.lit("OTHER")), F.coalesce(s["speaker"], F.lit("group"))
    return F.concat(kind, F.when((kind == "VERSE") & s["index"].isNotNull(), s["index"].cast("string")).otherwise(""), F.lit("("), speaker, F.lit(")"))


def structure_line(sections: Column) -> Column:
    return F.array_join(F.transform(sections, section_label), " > ")


def open_tag(s: Column) -> Column:
    kind, speaker = F.coalesce(s["type"], F.lit("OTHER")), F.coalesce(s["speaker"], F.lit("group"))
    return F.concat(F.lit("<"), kind, F.when(s["index"].isNotNull(), F.concat(F.lit(" index="), s["index"].cast("string"))).otherwise(""), F.lit(" speaker="), speaker, F.lit(">"))


def close_tag(s: Column) -> Column:
    return F.concat(F.lit("</"), F.coalesce(s["type"], F.lit("OTHER")), F.lit(">"))


def canonical_text(sections: Column) -> Column:
    """Tagged blocks of the sections with text, one blank line apart."""
    clean = F.filter(F.transform(sections, lambda s: s.withField("text", sanitize(s["text"]))), lambda s: s["text"] != "")
    return rstrip(F.array_join(F.transform(clean, lambda s: F.concat(open_tag(s), F.lit("\n"), s["text"], F.lit("\n"), close_tag(s))), "\n\n"))


def canonicalize(marked: DataFrame) -> DataFrame:
    """Marked songs -> artist, title, url, dominant_voice, structure, canonical_text, n_sections, n_chars."""
    sections = F.coalesce("sections", F.array().cast(marked.schema["sections"].dataType))
    ordered = marked.select("artist", "title", "url", F.coalesce("dominant_voice", F.lit("group")).alias("dominant_voice"), sort_sections(sections).alias("s"))
    text = ordered.withColumn("canonical_text", canonical_text(F.col("s")))
    return text.select(
        "artist", "title", "url", "dominant_voice", structure_line(F.col("s")).alias("structure"), "canonical_text",
        F.size(F.filter("s", lambda s: sanitize(s["text"]) != "")).alias("n_sections"), F.length("canonical_text").alias("n_chars"),
    )


def corpus_rows(canonical: DataFrame) -> DataFrame:
    return canonical.select("artist", "title", "url", "dominant_voice", "structure", F.col("canonical_text").alias("text"))


def index_rows(canonical: DataFrame) -> DataFrame:
    return canonical.select("title", "url", "dominant_voice", "structure", "n_sections", "n_chars")


def text_block(song: DataFrame) -> DataFrame:
    """One text value per song for the plain corpus file; a null field prints as None."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("None")))
    # The file's markers and labels.
    head = [line("TITLE", "title"), line("URL", "url"), line("ARTIST", "artist"), line("DOMINANT_VOICE", "dominant_voice"), line("STRUCTURE", "structure")]
    return song.select(F.concat_ws("\n", F.lit("=== SONG ==="), *head, F.lit(""), F.col("canonical_text"), F.lit("=== END SONG ==="), F.lit("")).alias("value"))


def parse_canonical(text: Column) -> Column:
    """Canonical text -> array of struct<type, index, speaker, text>; the inverse of canonical_text."""
    pattern = r"(?s)(<([A-Z_]+)\s+[^>]*>\n.*?\n</\2>)"
    head = r"(?sU)^<([A-Z_]+)(?: index=(\d+))? speaker=([^>]*)>\n(.*)\n</[A-Z_]+>$"
    part = lambda b, k: F.regexp_extract(b, head, k)
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda b: F.struct(part(b, 1).alias("type"), F.nullif(part(b, 2), F.lit("")).try_cast("int").alias("index"), part(b, 3).alias("speaker"), part(b, 4).alias("text")),
    )
