"""Registered queries over the reference's operators, with their DuckDB counterparts.

The driver's tables stand in for the engine's own: documents for section texts, conversations for songs (turns as
sections, roles as speakers), pages for crawled pages, benchmark for earlier sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.ranks import previous_key
from textloom.functions.text import LETTERS, lines, pstrip, squeeze, uniform, words
from textloom.operators import canonical, chat, generate, instruct, linefilter, scoring, sections
from textloom.sources import html
from textloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The driver's texts are Latin throughout.
LATIN_TEXTS = linefilter.FilterConfig(drop_latin_lines=False)
BASE = "https://example.org/list/index.html"
PREFIX = "p"
SPEAKERS = {"assistant": "helper", "user": "asker"}
KINDS = {"system": "INTRO", "user": "VERSE", "assistant": "CHORUS"}
PROMPTS = instruct.Prompts()


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


# ---------------------------------------------------------------- line filter

LINES = """t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM t),
l AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS line FROM r),
n AS (SELECT * FROM l WHERE line <> '')"""


def _joined(kept: str) -> str:
    return f"SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, md5(coalesce(body, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS body FROM {kept} GROUP BY doc_id) USING (doc_id)"


def _cap(source: str, most: int) -> str:
    return f"""a AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS island FROM {source}),
k AS (SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line, island ORDER BY pos) AS place FROM a) WHERE place <= {most})"""


def _lines_result(docs: DataFrame, kept: Column) -> DataFrame:
    return docs.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n_lines"), F.md5(F.array_join("k", "\n")).alias("digest"))


@query(f"WITH {LINES}, w AS (SELECT * FROM n WHERE len(string_split(line, ' ')) >= 3), {_cap('w', 2)} {_joined('k')}")
def line_clean(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _lines_result(docs, linefilter.clean_lines(lines(F.col("text")), LATIN_TEXTS))


@query(f"WITH {LINES}, w AS (SELECT * FROM n WHERE len(string_split(line, ' ')) >= 6) {_joined('w')}")
def line_min_words(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stripped = F.filter(F.transform(lines(F.col("text")), lambda x: squeeze(pstrip(x))), lambda x: x != "")
    kept = F.filter(stripped, lambda x: F.size(words(x)) >= 6)
    return _lines_result(docs, kept)


@query(f"WITH {LINES}, {_cap('n', 1)} {_joined('k')}")
def line_repeat_cap(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stripped = F.filter(F.transform(lines(F.col("text")), lambda x: squeeze(pstrip(x))), lambda x: x != "")
    return _lines_result(docs, linefilter.cap_repeats(stripped, 1))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, ' of ', chr(10) || chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def newline_collapse(spark, sf_dir):
    widened = F.replace(F.col("text"), F.lit(" of "), F.lit("\n\n\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.md5(canonical.collapse(widened)).alias("digest"))


@query(f"WITH {LINES}, w AS (SELECT * FROM n WHERE NOT regexp_matches(lower(line), '^(\\d+\\s+contributors?\\s*|read more\\s*|you might also like\\s*|.*(the|of)\\.\\s*)$')) {_joined('w')}")
def junk_line_filter(spark, sf_dir):
    junk = r"(?iuU)^(\d+\s+contributors?\s*|read more\s*|you might also like\s*|.*(the|of)\.\s*)$"
    stripped = F.filter(F.transform(lines(F.col("text")), lambda x: squeeze(pstrip(x))), lambda x: (x != "") & ~sections.is_junk(x, junk))
    return _lines_result(documents(spark, sf_dir), stripped)


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[A-Za-z]'))) AS INT) AS n_without_latin FROM documents")
def latin_line_filter(spark, sf_dir):
    kept = F.filter(F.split("text", "\n"), lambda x: ~linefilter.has_latin(x))
    return documents(spark, sf_dir).select("doc_id", F.size(kept).alias("n_without_latin"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(replace(text, 'e', 'е'), '[A-Za-zА-Яа-яЁё0-9_-]+'), lambda w: regexp_matches(w, '[А-Яа-яЁё]') AND regexp_matches(w, '[A-Za-z]'))) > 0 AS mixed FROM documents")
def mixed_script_filter(spark, sf_dir):
    """Each Latin e is made Cyrillic first, so that words mix scripts."""
    return documents(spark, sf_dir).select("doc_id", linefilter.has_mixed_word(F.replace(F.col("text"), F.lit("e"), F.lit("е"))).alias("mixed"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(replace(text, 'e', 'е'), '[А-Яа-яЁё]')) AS INT) AS cyr, CAST(len(regexp_extract_all(replace(text, 'e', 'е'), '[A-Za-z]')) AS INT) AS lat FROM documents")
def script_letter_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scoring.letter_counts(F.replace(F.col("text"), F.lit("e"), F.lit("е"))).alias("c")).select("doc_id", "c.cyr", "c.lat")


@query("""WITH s AS (SELECT doc_id, '<VERSE index=1 speaker=a>' || chr(10) || regexp_replace(text, '[^a-zA-Z \\n]', '', 'g') AS text FROM documents),
t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM s), r AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM t),
l AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS line FROM r),
w AS (SELECT * FROM l WHERE line <> '' AND (starts_with(line, '<') OR len(string_split(line, ' ')) >= 3)),
a AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS island FROM w),
k AS (SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line, island ORDER BY pos) AS place FROM a) WHERE place <= 2)
SELECT doc_id, md5(rtrim(string_agg(line, chr(10) ORDER BY pos) || chr(10), chr(10))) AS digest FROM k GROUP BY doc_id""")
def tagged_section_clean(spark, sf_dir):
    """Texts under an opening tag: it stays, and a closing tag that never was is not made up."""
    text = F.concat(F.lit("<VERSE index=1 speaker=a>\n"), F.regexp_replace("text", rf"[^{LETTERS} \n]+", ""))
    return documents(spark, sf_dir).select("doc_id", F.md5(linefilter.clean_section_text(text, LATIN_TEXTS)).alias("digest"))


# ---------------------------------------------------------------- scores

SCORED = """t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM t),
l AS (SELECT * FROM (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM r) WHERE line <> ''),
f AS (SELECT doc_id, line, count(*) AS k FROM l GROUP BY doc_id, line),
q AS (SELECT doc_id, max(k) AS max_repeat, count(*) AS n_distinct, sum(k) FILTER (place <= 3) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS place FROM f) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS body FROM l GROUP BY doc_id),
ws AS (SELECT doc_id, list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '') AS w FROM j),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS gram FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
gc AS (SELECT doc_id, count(gram) AS n_grams, count(DISTINCT gram) AS n_distinct_grams FROM g GROUP BY doc_id),
s AS (SELECT j.doc_id, n_lines, len(w) AS n_words, len(w) / n_lines::DOUBLE AS avg_words, n_distinct / n_lines::DOUBLE AS uniq_ratio, max_repeat, top3,
      (n_grams - n_distinct_grams) / greatest(1, n_grams)::DOUBLE AS repetition, len(regexp_extract_all(body, '[А-Яа-яЁё]')) AS cyr, len(regexp_extract_all(body, '[A-Za-z]')) AS lat
      FROM j JOIN q USING (doc_id) JOIN ws USING (doc_id) JOIN gc USING (doc_id)),
sc AS (SELECT d.doc_id, d.source, CASE WHEN n_lines IS NULL THEN -1e9 ELSE 4.0 * cyr / greatest(1, cyr + lat) + 0.1 * n_lines + 0.2 * avg_words + 2.0 * uniq_ratio
      - 4.0 * greatest(0, max_repeat - 2) - 0.8 * greatest(0, top3 - 8) - 3.5 * repetition - CASE WHEN uniq_ratio < 0.4 THEN 5.0 ELSE 0.0 END
      - 2.0 * greatest(0.0, avg_words - 20) - CASE WHEN lat > 0 THEN 10.0 ELSE 0.0 END END AS score FROM documents d LEFT JOIN s USING (doc_id))"""


def _where(docs: DataFrame, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """doc_id, v: the value of each document that passes the test. As a filter, the test would be moved below the value and
    compute it once more."""
    return docs.select("doc_id", F.explode(F.filter(F.array(value), test)).alias("v"))


@query(f"WITH {SCORED} SELECT doc_id, round(score::DOUBLE, 6) AS score FROM sc")
def section_score(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(scoring.score_section(F.col("text")), 6).alias("score"))


@query(f"WITH {SCORED} SELECT doc_id, CAST(max_repeat AS INT) AS max_repeat, CAST(top3 AS INT) AS top3 FROM s")
def line_frequency_top3(spark, sf_dir):
    found = _where(documents(spark, sf_dir), scoring.line_frequencies(scoring.content_lines(F.col("text"))), lambda f: f["n_distinct"] > 0)
    return found.select("doc_id", "v.max_repeat", "v.top3")


@query(f"WITH {SCORED} SELECT doc_id, round(repetition, 6) AS repetition FROM s")
def ngram4_repetition(spark, sf_dir):
    found = _where(documents(spark, sf_dir), scoring.content_lines(F.col("text")), lambda c: F.size(c) > 0)
    return found.select("doc_id", F.round(scoring.repetition(words(F.array_join("v", " "))), 6).alias("repetition"))


@query(f"WITH {SCORED} SELECT doc_id, round(avg_words, 6) AS avg_words, round(uniq_ratio, 6) AS uniq_ratio FROM s")
def avg_words_uniq_ratio(spark, sf_dir):
    found = _where(documents(spark, sf_dir), scoring.line_averages(F.col("text")), lambda s: s["n_lines"] > 0)
    return found.select("doc_id", F.round("v.avg_words", 6).alias("avg_words"), F.round("v.uniq_ratio", 6).alias("uniq_ratio"))


#: Line and 4-gram overlap of a document with the one before it in its source.
OVERLAP = SCORED + """,
b AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents),
dl AS (SELECT DISTINCT doc_id, line FROM l), dg AS (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL),
lo AS (SELECT b.doc_id, count(y.line) / count(*)::DOUBLE AS line_overlap FROM b JOIN dl ON dl.doc_id = b.doc_id LEFT JOIN dl y ON y.doc_id = b.prev AND y.line = dl.line GROUP BY b.doc_id),
go AS (SELECT b.doc_id, count(y.gram) / count(*)::DOUBLE AS ngram_overlap FROM b JOIN dg ON dg.doc_id = b.doc_id LEFT JOIN dg y ON y.doc_id = b.prev AND y.gram = dg.gram GROUP BY b.doc_id)"""


def _with_previous(docs: DataFrame) -> DataFrame:
    """Each document with the text before it in its source, null for the first: ids are ranked in ranges, so that no source
    is met in one task, and texts are joined by id."""
    order = previous_key(docs, "source", "doc_id").select("doc_id", F.col("previous").alias("before"))
    texts = docs.select(F.col("doc_id").alias("before"), F.col("text").alias("previous"))
    return docs.join(order, "doc_id").join(texts, "before", "left")


@query(f"WITH {OVERLAP} SELECT doc_id, round(line_overlap, 6) AS line_overlap FROM lo")
def line_overlap(spark, sf_dir):
    found = _with_previous(documents(spark, sf_dir)).filter(F.size(scoring.content_lines(F.col("text"))) > 0)
    return found.select("doc_id", F.round(scoring.line_overlap(F.col("text"), F.col("previous")), 6).alias("line_overlap"))


@query(f"WITH {OVERLAP} SELECT doc_id, round(score::DOUBLE - CASE WHEN score = -1e9 THEN 0 ELSE 8.0 * coalesce(line_overlap, 0) + 6.0 * coalesce(ngram_overlap, 0) END, 6) AS score FROM b JOIN sc USING (doc_id) LEFT JOIN lo USING (doc_id) LEFT JOIN go USING (doc_id)")
def score_in_context(spark, sf_dir):
    found = _with_previous(documents(spark, sf_dir))
    return found.select("doc_id", F.round(scoring.score_in_context(F.col("text"), F.col("previous")), 6).alias("score"))


@query(f"""WITH {SCORED}, dg AS (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL), dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY doc_id),
bw AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), bp AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM bw),
bg AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS gram FROM bp WINDOW d AS (PARTITION BY item_id ORDER BY i)) WHERE gram IS NOT NULL)
SELECT doc_id, item_id, count(*) AS n_shared, round(count(*) / max(n)::DOUBLE, 6) AS ratio FROM dg JOIN bg USING (gram) JOIN dn USING (doc_id) GROUP BY doc_id, item_id""")
def ngram4_overlap(spark, sf_dir):
    found = scoring.ngram_matches(documents(spark, sf_dir), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    return found.select("doc_id", "item_id", "n_shared", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {SCORED}, x AS (SELECT *, round(score::DOUBLE, 6) AS r FROM sc) SELECT x.source, doc_id, r AS score, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r DESC, doc_id) AS place FROM x) x JOIN documents USING (doc_id) WHERE place = 1")
def best_candidate(spark, sf_dir):
    scored = documents(spark, sf_dir).select("source", "doc_id", F.round(scoring.score_section(F.col("text")), 6).alias("score"), "text")
    return scoring.best_candidate(scored, "source", "doc_id").select("source", "doc_id", "score", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- sections and canonical markup

CASES = "CASE role WHEN 'system' THEN 'INTRO' WHEN 'user' THEN 'VERSE' ELSE 'CHORUS' END"
VOICES = "CASE role WHEN 'assistant' THEN 'helper' WHEN 'user' THEN 'asker' ELSE 'group' END"
CANON = f"""c AS (SELECT conv_id, turn, role, text, {CASES} AS type, {VOICES} AS speaker FROM conversations),
v AS (SELECT *, CASE WHEN type = 'VERSE' THEN row_number() OVER (PARTITION BY conv_id, type ORDER BY turn) END AS idx FROM c)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def rendered_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, lyrics: conversations as bracket-headed songs, `[Verse 1: user]` and the turn's text."""
    kind = F.initcap(F.lower(_mapped("role", KINDS)))
    number = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    block = F.concat(F.lit("["), kind, F.when(F.col("role") == "user", F.concat(F.lit(" "), number.cast("string"))).otherwise(""), F.lit(": "), F.col("role"), F.lit("]\n"), F.col("text"))
    rows = conversations(spark, sf_dir).withColumn("block", block)
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("b"))
    return joined.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("lyrics"))


def _mapped(column: str, names: dict[str, str]) -> Column:
    out = F.when(F.col(column) == next(iter(names)), names[next(iter(names))])
    for k, v in list(names.items())[1:]:
        out = out.when(F.col(column) == k, v)
    return out


MARKUP = sections.Markup(speakers=SPEAKERS)


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked songs of the conversations, by rendering and splitting them again."""
    raw = rendered_songs(spark, sf_dir).select(F.lit("artist").alias("artist"), F.col("conv_id").cast("string").alias("title"), F.concat(F.lit("u/"), F.col("conv_id").cast("string")).alias("url"), "lyrics")
    return sections.mark_songs(raw, MARKUP)


@query(f"WITH {CANON} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS \"order\", type, CAST(idx AS INT) AS \"index\", speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM v")
def section_split(spark, sf_dir):
    split = rendered_songs(spark, sf_dir).select("conv_id", F.inline(sections.split_sections(F.col("lyrics"), MARKUP)))
    return split.select("conv_id", "order", "type", "index", "speaker", "text")


@query("SELECT conv_id, turn, upper(CASE role WHEN 'system' THEN 'intro' WHEN 'user' THEN 'verse' ELSE 'chorus' END) AS type, CAST(turn AS INT) AS \"index\", role AS speaker_raw FROM conversations")
def header_parse(spark, sf_dir):
    header = F.concat(F.initcap(F.lower(_mapped("role", KINDS))), F.lit(" "), F.col("turn").cast("string"), F.lit(" : "), F.col("role"), F.lit(" "))
    parsed = conversations(spark, sf_dir).select("conv_id", "turn", sections.parse_header(header).alias("h"))
    return parsed.select("conv_id", "turn", "h.type", "h.index", "h.speaker_raw")


@query(f"SELECT conv_id, turn, {VOICES} AS speaker FROM conversations")
def speaker_normalize(spark, sf_dir):
    raw = F.concat(F.lit(" Feat. "), F.upper("role"), F.lit("  x"))
    return conversations(spark, sf_dir).select("conv_id", "turn", sections.normalize_speaker(raw, SPEAKERS).alias("speaker"))


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'helper' ELSE 'group' END AS speaker, role FROM conversations),
n AS (SELECT conv_id, count(DISTINCT speaker) FILTER (speaker <> 'group') AS k, max(speaker) FILTER (speaker <> 'group') AS only_one FROM c GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN k = 1 AND speaker = 'group' THEN only_one ELSE speaker END AS speaker FROM c JOIN n USING (conv_id)""")
def single_speaker_inference(spark, sf_dir):
    turns = conversations(spark, sf_dir).select("conv_id", F.struct(F.col("turn").alias("order"), F.when(F.col("role") == "assistant", "helper").otherwise("group").alias("speaker")).alias("s"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("conv_id", F.inline(sections.infer_single_speaker(F.col("s")))).select("conv_id", F.col("order").alias("turn"), "speaker")


@query("""WITH s AS (SELECT conv_id, role, sum(length(text)) AS n, min(turn) AS first FROM conversations GROUP BY conv_id, role)
SELECT conv_id, role AS dominant_voice FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS place FROM s) WHERE place = 1""")
def dominant_voice(spark, sf_dir):
    return sections.dominant_voice_by_rows(conversations(spark, sf_dir), "conv_id", "role", "text", "turn")


INFERRED = CANON + """,
k AS (SELECT conv_id, count(DISTINCT speaker) FILTER (speaker <> 'group') AS n, max(speaker) FILTER (speaker <> 'group') AS only_one FROM v GROUP BY conv_id),
i AS (SELECT conv_id, turn, type, idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN n = 1 AND speaker = 'group' THEN only_one ELSE speaker END AS speaker FROM v JOIN k USING (conv_id))"""
STRUCTURE = "string_agg(type || CASE WHEN type = 'VERSE' THEN CAST(idx AS VARCHAR) ELSE '' END || '(' || speaker || ')', ' > ' ORDER BY turn) AS structure"
BODY = "string_agg('<' || type || CASE WHEN idx IS NOT NULL THEN ' index=' || idx ELSE '' END || ' speaker=' || speaker || '>' || chr(10) || text || chr(10) || '</' || type || '>', chr(10) || chr(10) ORDER BY turn)"


@query(f"WITH {INFERRED} SELECT CAST(conv_id AS VARCHAR) AS title, {STRUCTURE} FROM i GROUP BY conv_id")
def structure_line(spark, sf_dir):
    return canonical.canonicalize(songs(spark, sf_dir)).select("title", "structure")


@query(f"WITH {INFERRED} SELECT CAST(conv_id AS VARCHAR) AS title, md5({BODY}) AS digest FROM i GROUP BY conv_id")
def canonical_text(spark, sf_dir):
    return canonical.corpus_rows(canonical.canonicalize(songs(spark, sf_dir))).select("title", F.md5("text").alias("digest"))


@query(f"""WITH {INFERRED}, t AS (SELECT conv_id, speaker, sum(length(text)) AS n, min(turn) AS first FROM i GROUP BY conv_id, speaker),
m AS (SELECT conv_id, speaker AS dominant_voice FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS place FROM t) WHERE place = 1)
SELECT CAST(conv_id AS VARCHAR) AS title, 'u/' || conv_id AS url, max(dominant_voice) AS dominant_voice, {STRUCTURE}, CAST(count(*) AS INT) AS n_sections, CAST(length({BODY}) AS INT) AS n_chars FROM i JOIN m USING (conv_id) GROUP BY conv_id""")
def canonical_index(spark, sf_dir):
    return canonical.index_rows(canonical.canonicalize(songs(spark, sf_dir)))


@query(f"WITH {INFERRED} SELECT CAST(conv_id AS VARCHAR) AS title, type, CAST(idx AS INT) AS \"index\", speaker, md5(text) AS digest FROM i")
def canonical_round_trip(spark, sf_dir):
    """Rendered markup parsed back into sections."""
    text = canonical.canonicalize(songs(spark, sf_dir)).select("title", F.inline(canonical.parse_canonical(F.col("canonical_text"))))
    return text.select("title", "type", "index", "speaker", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- pages

HREFS = """x AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages),
a AS (SELECT page_id, unnest(hs) AS href, CAST(generate_subscripts(hs, 1) - 1 AS INT) AS pos FROM x),
u AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://example.org' || href
      WHEN href = '' THEN 'https://example.org/list/index.html' WHEN href[1] IN ('#', '?') THEN 'https://example.org/list/index.html' || href ELSE 'https://example.org/list/' || href END AS url FROM a),
pt AS (SELECT *, ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path FROM u)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.links(table(spark, sf_dir, "pages"))
    return found.withColumn("url", html.resolve(BASE, F.col("href"))).withColumn("path", html.url_path(F.col("url")))


@query(f"WITH {HREFS} SELECT page_id, pos, href FROM a")
def link_extract(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


@query(f"WITH {HREFS} SELECT page_id, pos, url FROM u")
def url_resolve(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "pos", "url")


@query(f"WITH {HREFS} SELECT page_id, pos, path FROM pt WHERE starts_with(path, '{PREFIX}')")
def url_path_prefix(spark, sf_dir):
    return page_links(spark, sf_dir).filter(F.col("path").startswith(PREFIX)).select("page_id", "pos", "path")


@query(f"WITH {HREFS} SELECT url, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS place FROM u) WHERE place = 1")
def first_seen_links(spark, sf_dir):
    return html.first_seen(page_links(spark, sf_dir), "url", "page_id", "pos").select("url", "page_id", "pos")


@query(f"WITH {HREFS} SELECT page_id, pos, replace(replace(replace(path, '{PREFIX}', ''), '-lyrics', ''), '-', ' ') AS title FROM pt")
def slug_title(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "pos", html.slug_title(F.col("path"), PREFIX).alias("title"))


@query()
def text_extract(spark, sf_dir):
    """Text by the parser; SQL has no HTML parser."""
    return html.extract_text(table(spark, sf_dir, "pages"), selectors=[("article", None, None), ("body", None, None)])


@query("SELECT page_id, CASE WHEN length(coalesce(html, '')) < 3000 THEN 'EMPTY_OR_SHORT' END AS status FROM pages")
def short_page_gate(spark, sf_dir):
    return html.length_gate(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), 3000).select("page_id", "status")


@query("SELECT 'x' AS artist, 'page ' || page_id AS title, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def resume_anti_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    index = pages.select(F.concat(F.lit(" page "), F.col("page_id").cast("string")).alias("title"), "url")
    return html.todo(index, pages.filter("page_id % 3 = 0"), "x")


# ---------------------------------------------------------------- instructions, chat

CORPUS = INFERRED + f", corpus AS (SELECT CAST(conv_id AS VARCHAR) AS title, {STRUCTURE}, {BODY} AS text FROM i GROUP BY conv_id)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.corpus_rows(canonical.canonicalize(songs(spark, sf_dir))).select("title", "structure", "text")


def _u(key: str, *names: str) -> str:
    joined = " || ':' || ".join(["'42'", key, *[f"'{n}'" for n in names]])
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in PROMPTS.topics) + "]"


def _theme(task: str) -> str:
    topic = f"{TOPIC_LIST}[1 + floor({_u('title', task, 'topic')} * {len(PROMPTS.topics)})::INT]"
    return f"CASE WHEN {_u('title', task, 'theme')} < 0.55 OR title = '' THEN {topic} ELSE title END"


@query(f"WITH {INFERRED} SELECT CAST(conv_id AS VARCHAR) AS title, CAST(count(*) AS INT) AS n_blocks, md5({BODY}) AS digest FROM i GROUP BY conv_id")
def block_extract(spark, sf_dir):
    blocks = corpus(spark, sf_dir).select("title", instruct.extract_blocks(F.col("text")).alias("b"))
    return blocks.select("title", F.size("b").alias("n_blocks"), F.md5(F.array_join("b", "\n\n")).alias("digest"))


@query(f"WITH {INFERRED} SELECT CAST(conv_id AS VARCHAR) AS title, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, speaker FROM i")
def block_speaker(spark, sf_dir):
    blocks = corpus(spark, sf_dir).select("title", F.posexplode(instruct.extract_blocks(F.col("text"))).alias("pos", "b"))
    return blocks.select("title", "pos", instruct.block_speaker(F.col("b"), PROMPTS.default_speaker).alias("speaker"))


def _sql(template: str, **values: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("\n", "' || chr(10) || '") + "'" for i, p in enumerate(parts))


@query(f"WITH {CORPUS} SELECT title, md5({_sql(PROMPTS.full_song, theme=_theme('full'), structure='structure')}) AS prompt, md5(text) AS answer FROM corpus")
def full_song_task(spark, sf_dir):
    made = corpus(spark, sf_dir).select("title", instruct.full_song(F.col("title"), F.col("title"), F.col("structure"), F.col("text"), PROMPTS).alias("m"))
    return made.select("title", F.md5(F.col("m")[1]["content"]).alias("prompt"), F.md5(F.col("m")[2]["content"]).alias("answer"))


NEXT = INFERRED + f""", b AS (SELECT CAST(conv_id AS VARCHAR) AS title, turn, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n,
'<' || type || CASE WHEN idx IS NOT NULL THEN ' index=' || idx ELSE '' END || ' speaker=' || speaker || '>' || chr(10) || text || chr(10) || '</' || type || '>' AS block FROM i),
z AS (SELECT *, 1 + floor({_u('title', 'next2', 'place')} * (n - 1))::INT AS target FROM b WHERE n >= 2),
cx AS (SELECT title, string_agg(block, chr(10) || chr(10) ORDER BY k) AS context FROM z WHERE k BETWEEN target - 2 AND target - 1 GROUP BY title)"""


@query(f"WITH {NEXT} SELECT title, md5({_sql(PROMPTS.next_section, theme=_theme('next2'), speaker='speaker', context='context')}) AS prompt, md5(block) AS answer FROM z JOIN cx USING (title) WHERE k = target")
def next_section_task(spark, sf_dir):
    made = corpus(spark, sf_dir).select("title", instruct.next_section(F.col("title"), F.col("title"), F.col("text"), 2, PROMPTS).alias("m")).filter("m IS NOT NULL")
    return made.select("title", F.md5(F.col("m")[1]["content"]).alias("prompt"), F.md5(F.col("m")[2]["content"]).alias("answer"))


@query(f"""WITH {NEXT}, ch AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY k) - 1 AS c, count(*) OVER (PARTITION BY title) AS m FROM b WHERE starts_with(block, '<CHORUS'))
SELECT title, md5({_sql(PROMPTS.chorus, theme=_theme('chorus'), speaker='speaker')}) AS prompt, md5(block) AS answer FROM ch WHERE c = floor({_u('title', 'chorus', 'pick')} * m)""")
def chorus_task(spark, sf_dir):
    made = corpus(spark, sf_dir).select("title", instruct.chorus_only(F.col("title"), F.col("title"), F.col("text"), PROMPTS).alias("m")).filter("m IS NOT NULL")
    return made.select("title", F.md5(F.col("m")[1]["content"]).alias("prompt"), F.md5(F.col("m")[2]["content"]).alias("answer"))


@query(f"SELECT doc_id FROM documents WHERE {_u('CAST(doc_id AS VARCHAR)', 'draw')} < 0.35")
def bernoulli_sample(spark, sf_dir):
    return documents(spark, sf_dir).filter(uniform("42", F.col("doc_id").cast("string"), "draw") < 0.35).select("doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.05::DOUBLE)) THEN 'valid' ELSE 'train' END AS split FROM documents")
def train_valid_split(spark, sf_dir):
    return instruct.train_valid_split(documents(spark, sf_dir).select("doc_id"), ("doc_id",))


def _target(task: str, k: int) -> str:
    return f"""z{k} AS (SELECT *, 1 + floor({_u('title', task, 'place')} * (n - 1))::INT AS target FROM b WHERE n >= 2),
cx{k} AS (SELECT title, string_agg(block, chr(10) || chr(10) ORDER BY k) AS context FROM z{k} WHERE k BETWEEN target - {k} AND target - 1 GROUP BY title)"""


def _next_prompt(task: str) -> str:
    return _sql(PROMPTS.next_section, theme=_theme(task), speaker="speaker", context="context")


@query(f"""WITH {NEXT}, corpus AS (SELECT CAST(conv_id AS VARCHAR) AS title, {STRUCTURE}, {BODY} AS text FROM i GROUP BY conv_id), {_target('next2', 2)}, {_target('next1', 1)},
ch AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY k) - 1 AS c, count(*) OVER (PARTITION BY title) AS m FROM b WHERE starts_with(block, '<CHORUS')),
x AS (SELECT title, 'full' AS task, {_sql(PROMPTS.full_song, theme=_theme('full'), structure='structure')} AS prompt, text AS answer FROM corpus
UNION ALL SELECT title, 'next2', {_next_prompt('next2')}, block FROM z2 JOIN cx2 USING (title) WHERE k = target
UNION ALL SELECT title, 'next1', {_next_prompt('next1')}, block FROM z1 JOIN cx1 USING (title) WHERE k = target AND {_u('title', 'next1', 'draw')} < 0.35
UNION ALL SELECT title, 'chorus', {_sql(PROMPTS.chorus, theme=_theme('chorus'), speaker='speaker')}, block FROM ch WHERE c = floor({_u('title', 'chorus', 'pick')} * m) AND {_u('title', 'chorus', 'draw')} < 0.45)
SELECT title, task, md5('system: {PROMPTS.system}|user: ' || prompt || '|assistant: ' || answer) AS digest FROM x""")
def build_dataset(spark, sf_dir):
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|")
    return instruct.build_dataset(corpus(spark, sf_dir), "title").select("title", "task", F.md5(said).alias("digest"))


@query("SELECT conv_id, CAST(count(*) AS INT) AS n_messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    m = chat.messages_of(conversations(spark, sf_dir), "conv_id")
    return m.select("conv_id", F.size("messages").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("""WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, md5('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10)
 || coalesce(max(body) FILTER (place = 1 AND role = 'system'), '') || '<|eot_id|>'
 || coalesce(string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || body || '<|eot_id|>', '' ORDER BY turn) FILTER (NOT (place = 1 AND role = 'system')), '')) AS digest FROM m GROUP BY conv_id""")
def chat_template(spark, sf_dir):
    return chat.messages_of(conversations(spark, sf_dir), "conv_id").select("conv_id", F.md5(chat.render(F.col("messages"))).alias("digest"))


@query("""WITH w AS (SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents),
c AS (SELECT doc_id, sum(n) OVER (ORDER BY md5('42:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM w)
SELECT doc_id, CAST(floor((greatest(upto, 1) - 1) / 2048) AS BIGINT) AS bin FROM c""")
def pack_sequences(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", F.size(words(F.col("text"))).alias("n"))
    return chat.pack(sized, "doc_id", F.col("n")).select("doc_id", "bin")


# ---------------------------------------------------------------- generation

PLANS = "p AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'INTRO' WHEN 'user' THEN 'VERSE' ELSE 'CHORUS' END AS type, role AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations)"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).withColumn("s", F.concat(F.lower(_mapped("role", KINDS)), F.lit(" ( "), F.upper("role"), F.lit(" )")))
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("t"))
    return joined.select("conv_id", generate.parse_structure(F.array_join(F.transform("t", lambda x: x["s"]), " > ")).alias("plan"))


@query(f"WITH {PLANS} SELECT conv_id, CAST(step AS INT) AS step, type, speaker FROM p")
def structure_parse(spark, sf_dir):
    return plans(spark, sf_dir).select("conv_id", F.posexplode("plan").alias("step", "x")).select("conv_id", "step", "x.type", "x.speaker")


@query(f"WITH {PLANS} SELECT conv_id, CAST(step AS INT) AS step, CAST(CASE WHEN type = 'VERSE' THEN row_number() OVER (PARTITION BY conv_id, type ORDER BY step) END AS INT) AS \"index\" FROM p")
def verse_index(spark, sf_dir):
    return plans(spark, sf_dir).select("conv_id", F.posexplode("plan").alias("step", "x")).select("conv_id", "step", "x.index")


@query("""SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), lag(text, 2) OVER w, lag(text, 1) OVER w)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    return conversations(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(w), "\n\n")).alias("context"))


@query(f"WITH {PLANS} SELECT conv_id, CAST(step AS INT) AS step, CAST(a AS INT) AS attempt, CAST(42 + 100 * step + a AS INT) AS seed FROM p, (SELECT unnest(range(3)) AS a)")
def seed_schedule(spark, sf_dir):
    steps = plans(spark, sf_dir).select("conv_id", F.posexplode("plan").alias("step", "x")).select("conv_id", "step", F.explode(F.sequence(F.lit(0), F.lit(generate.Sampling().tries - 1))).alias("attempt"))
    return steps.select("conv_id", "step", "attempt", generate.step_seed(generate.Sampling().seed, F.col("step"), F.col("attempt")).alias("seed"))


_W = generate.Wording()
_OPEN = "'<' || type || CASE WHEN type = 'VERSE' THEN ' index=' || idx ELSE '' END || ' speaker=' || speaker || '>'"
_RULES = "(" + _sql(_W.rules, open_tag=_OPEN, close_tag="'</' || type || '>'") + ")"


@query(f"""WITH {PLANS}, q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, type ORDER BY step) AS idx FROM p),
t AS (SELECT conv_id, turn, regexp_replace(concat_ws(chr(10) || chr(10), lag(text, 2) OVER w, lag(text, 1) OVER w), '^\\s+|\\s+$', '', 'g') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(step AS INT) AS step, md5(CASE WHEN context = '' THEN {_sql(_W.plain, theme="'night'", rules=_RULES)} ELSE {_sql(_W.with_context, theme="'night'", rules=_RULES, context='context')} END) AS prompt FROM q JOIN t USING (conv_id, turn)""")
def prompt_build(spark, sf_dir):
    texts = conversations(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    steps = plans(spark, sf_dir).join(texts, "conv_id").select("conv_id", "texts", F.posexplode("plan").alias("step", "x"))
    context = generate.context_of(F.col("texts"), F.col("step"))
    return steps.select("conv_id", "step", F.md5(generate.section_prompt(F.lit("night"), F.col("x.type"), F.col("x.speaker"), F.col("x.index"), context)).alias("prompt"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents and their scores, the twenty best."""
    cleaned = documents(spark, sf_dir).select("doc_id", linefilter.clean_section_text(F.col("text"), LATIN_TEXTS).alias("text"))
    scored = cleaned.select("doc_id", "text", F.round(scoring.score_section(F.col("text")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)

