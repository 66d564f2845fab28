"""Registered queries over sources, sinks, page parsing and generation: each renders a driver table into the form that the
operator reads, writes it in the shared folder where a sink is meant, and reads it back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import lines, newlines, words
from textloom.operators import canonical, chat, generate, instruct, linefilter, scoring, sections
from textloom.plans.catalog import BASE, BODY, INFERRED, KINDS, LINES, ORACLES, QUERIES, STRUCTURE, _cap, _joined, _lines_result, _mapped, conversations, documents, query, songs
from textloom.sources import html, records
from textloom.tables import scratch_path, table

__all__ = ["ORACLES", "QUERIES"]

# ---------------------------------------------------------------- files

#: Titles and urls of the pages; a third has no title.
ENTRIES = "e AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'ä ' || page_id END AS title, 'u/' || page_id AS url FROM pages)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("ä "), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.concat(F.lit("u/"), F.col("page_id").cast("string")).alias("url"))


@query(f"WITH {ENTRIES} SELECT title, url FROM e")
def strict_scan(spark, sf_dir):
    """JSON lines with blank lines between them."""
    path = scratch_path(spark, "strict")
    entries(spark, sf_dir).select(F.concat(F.lit("\n"), F.to_json(F.struct("title", "url"), {"ignoreNullFields": "false"}), F.lit("\n")).alias("value")).write.text(path)
    return records.read_strict(spark, path, records.INDEX)


@query(f"WITH {ENTRIES} SELECT DISTINCT url FROM e WHERE page_id % 2 = 0")
def tolerant_scan(spark, sf_dir):
    """Every second line is cut in its middle, and every line occurs twice."""
    path = scratch_path(spark, "tolerant")
    line = F.to_json(F.struct("title", "url"))
    rows = entries(spark, sf_dir).select(F.when(F.col("page_id") % 2 == 0, line).otherwise(F.substring(line, 1, 9)).alias("value"))
    rows.unionAll(rows).write.text(path)
    return records.read_done(spark, path)


@query(f"""WITH {ENTRIES} SELECT '{{"title":' || CASE WHEN title IS NULL THEN 'null' ELSE '"' || title || '"' END || ',"url":"' || url || '"}}' AS line FROM e""")
def jsonl_sink(spark, sf_dir):
    """Lines as they stand in the file."""
    path = scratch_path(spark, "jsonl")
    records.write_jsonl(entries(spark, sf_dir).select("title", "url"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {ENTRIES} SELECT title, url FROM e")
def overwrite_sink(spark, sf_dir):
    """A second run replaces what the first has written."""
    path = scratch_path(spark, "overwrite")
    for _ in range(2):
        records.write_jsonl(entries(spark, sf_dir).select("title", "url"), path)
    return records.read_strict(spark, path, records.INDEX)


@query(f"WITH {ENTRIES} SELECT title, url FROM e")
def append_sink(spark, sf_dir):
    """Two runs, each of which adds its half."""
    path = scratch_path(spark, "append")
    for part in range(2):
        records.write_jsonl(entries(spark, sf_dir).filter(F.col("page_id") % 2 == part).select("title", "url"), path, "append")
    return records.read_strict(spark, path, records.INDEX)


@query(f"WITH {ENTRIES} SELECT CASE WHEN page_id % 2 = 0 THEN 'ERROR' ELSE 'EMPTY_OR_SHORT' END || chr(9) || url || chr(9) || coalesce(title || chr(9), '') || 'E: ' || page_id AS line FROM e")
def error_sink(spark, sf_dir):
    path = scratch_path(spark, "errors")
    rows = entries(spark, sf_dir).withColumn("detail", F.concat(F.lit("E: "), F.col("page_id").cast("string")))
    for part, kind in enumerate(("ERROR", html.TOO_SHORT)):
        records.write_errors(rows.withColumn("kind", F.when(F.col("page_id") % 2 == part, kind)), path, "kind", detail="detail")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT 'PATH_NOT_FOUND' AS error")
def missing_input(spark, sf_dir):
    """A scan of a path that does not exist."""
    try:
        records.read_strict(spark, scratch_path(spark, "missing"), records.INDEX).count()
        found = "none"
    except AnalysisException as why:
        found = why.getCondition()
    return spark.range(1).select(F.lit(found).alias("error"))


DOMINANT = INFERRED + """, t AS (SELECT conv_id, speaker, sum(length(text)) AS n, min(turn) AS first FROM i GROUP BY conv_id, speaker),
m AS (SELECT conv_id, speaker AS dominant_voice FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS place FROM t) WHERE place = 1)"""


@query(f"""WITH {DOMINANT}, s AS (SELECT conv_id, {STRUCTURE}, {BODY} AS body FROM i GROUP BY conv_id),
f AS (SELECT string_split('=== SONG ===' || chr(10) || 'TITLE: ' || conv_id || chr(10) || 'URL: u/' || conv_id || chr(10) || 'ARTIST: artist' || chr(10) || 'DOMINANT_VOICE: ' || dominant_voice || chr(10) || 'STRUCTURE: ' || structure
 || chr(10) || chr(10) || body || chr(10) || '=== END SONG ===' || chr(10), chr(10)) AS ls FROM s JOIN m USING (conv_id)), u AS (SELECT unnest(ls) AS line FROM f)
SELECT line, count(*) AS n FROM u GROUP BY line""")
def corpus_text_sink(spark, sf_dir):
    """Lines of the plain corpus file."""
    path = scratch_path(spark, "corpus")
    canonical.text_block(canonical.canonicalize(songs(spark, sf_dir))).write.text(path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOMINANT} SELECT CAST(conv_id AS VARCHAR) AS title, max(dominant_voice) AS dominant_voice, CAST(count(*) AS INT) AS n_sections, md5({BODY}) AS digest, (SELECT count(DISTINCT conv_id) FROM i) AS n_songs FROM i JOIN m USING (conv_id) GROUP BY conv_id""")
def canonical_sinks(spark, sf_dir):
    """Three files of one computation, two of them read back, with the counted songs."""
    path = scratch_path(spark, "canonical")
    n = records.write_canonical(canonical.canonicalize(songs(spark, sf_dir)), path)
    index = spark.read.schema("title string, n_sections int").json(f"{path}/canonical_index.jsonl")
    rows = records.read_strict(spark, f"{path}/canonical_corpus.jsonl", records.CORPUS).join(index, "title")
    return rows.select("title", "dominant_voice", "n_sections", F.md5("text").alias("digest"), F.lit(n).cast("long").alias("n_songs"))


@query("""WITH m AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT CASE WHEN row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) <= greatest(1, floor((SELECT count(*) FROM m) * 0.05::DOUBLE)) THEN 'valid' ELSE 'train' END AS split, md5(body) AS digest FROM m""")
def split_files(spark, sf_dir):
    path = scratch_path(spark, "splits")
    records.write_splits(instruct.train_valid_split(chat.messages_of(conversations(spark, sf_dir), "conv_id"), ("conv_id",)), path)
    joined = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return records.read_splits(spark, path).select("split", F.md5(joined).alias("digest"))


# ---------------------------------------------------------------- pages


@query(f"""WITH {LINES}, s AS (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM r), b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM s WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, md5(regexp_replace(coalesce(body, '') || CASE WHEN d.doc_id % 2 = 0 THEN chr(10) || chr(10) || 'end & more' ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS digest, NULL::VARCHAR AS error FROM documents d LEFT JOIN b USING (doc_id)""")
def container_text(spark, sf_dir):
    """Even documents are in two containers, odd ones in the first of two elements of the older kind."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.replace(escaped, F.lit("\n"), F.lit("<br>"))
    new = F.concat(F.lit('<html><p>head</p><div data-lyrics-container="true">'), body, F.lit('</div><script>no</script><div data-lyrics-container="true">end &amp; more</div>'))
    old = F.concat(F.lit('<div class="a lyrics">'), body, F.lit('<!-- no --></div><div class="lyrics">no</div>'))
    pages = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, new).otherwise(old).alias("html"))
    return html.extract_text(pages, "doc_id").select("doc_id", F.md5("text").alias("digest"), "error")


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'Title' || page_id ELSE 'some name ' || page_id END AS title, 'https://example.org/pre-some-name-' || page_id || '-lyrics' AS url FROM pages")
def heading_titles(spark, sf_dir):
    """Index entries of rendered pages: the heading's text where a link has one, else the slug; every link is met three times."""
    n = F.col("page_id").cast("string")
    href = F.concat(F.lit("pre-some-name-"), n, F.lit("-lyrics"))
    link = F.concat(F.lit('<a class="x" href="../'), href, F.lit('">'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<h3> Title <b>"), n, F.lit("</b></h3>"))).otherwise("x"), F.lit("</a>"))
    again = F.concat(F.lit('<A HREF="/'), href, F.lit('"><h3>other</h3></A><a href="//example.org/'), href, F.lit('">x</a><a>none</a><a href="http://[bad-lyrics">x</a>'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(link, again).alias("html"))
    return html.song_index(pages, BASE, "-lyrics", "pre-")


@query("""SELECT page_id, kind, CASE kind WHEN 0 THEN 'https://example.org/d/' || page_id WHEN 1 THEN 'https://example.org/list/a/b.html' WHEN 2 THEN 'https://example.org/x?q=' || page_id WHEN 3 THEN 'https://h.org/z'
WHEN 4 THEN 'mailto:a' || page_id WHEN 6 THEN 'https://example.org/list/index.html#f' END AS url, CASE WHEN kind = 5 THEN 'ValueError' END AS error FROM pages, (SELECT unnest(range(7)) AS kind)""")
def url_resolve_any(spark, sf_dir):
    """References with dot segments, of other schemes, and broken ones."""
    n = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("../d/./e/../"), n), F.lit("a/b.html"), F.concat(F.lit("/x?q="), n), F.lit("//h.org/z"), F.concat(F.lit("mailto:a"), n), F.lit("http://[bad"), F.lit("#f")]
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("kind", "href"))
    found = rows.withColumn("r", html.resolve_any(BASE, F.col("href")))
    return found.select("page_id", F.col("kind").cast("long").alias("kind"), "r.url", F.regexp_extract("r.error", "^[A-Za-z]+", 0).alias("error"))


# ---------------------------------------------------------------- songs


@query("SELECT doc_id, md5(replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10))) AS digest FROM documents")
def newline_normalize(spark, sf_dir):
    mixed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    return documents(spark, sf_dir).select("doc_id", F.md5(newlines(mixed)).alias("digest"))


@query("SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS after_marker, md5('about' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS without_marker FROM conversations")
def clean_lyrics(spark, sf_dir):
    """Description before the marker, a header, litter and bracket lines go; without a marker the description stays."""
    tail = F.concat(F.lit("[Verse 1: x]\r\n"), F.col("text"), F.lit("\n3 Contributors\n[laughs]\nRead more\nSome Lyrics\n"))
    marked, bare = F.concat(F.lit("about\n[Текст песни «x»]\n"), tail), F.concat(F.lit("about\n"), tail)
    return conversations(spark, sf_dir).select("conv_id", "turn", F.md5(sections.clean_lyrics(marked)).alias("after_marker"), F.md5(sections.clean_lyrics(bare)).alias("without_marker"))


@query("SELECT conv_id, turn, 'first line ' || turn || ' ' || role || ',' || chr(10) || 'a next whole line (' || chr(10) || chr(10) || 'new stanza here!' AS text FROM conversations")
def stitched_lines(spark, sf_dir):
    """Lines that were broken at a word and at punctuation, put together again."""
    broken = F.concat(F.lit("first line "), F.col("turn").cast("string"), F.lit("\n"), F.col("role"), F.lit("\n,\na next whole line\n(\n\nnew stanza here\n!"))
    return conversations(spark, sf_dir).select("conv_id", "turn", sections.stitch(broken).alias("text"))


@query(f"""WITH {DOMINANT} SELECT 'artist' AS artist, CAST(conv_id AS VARCHAR) AS title, 'u/' || conv_id AS url, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS lyrics, CAST(count(*) AS INT) AS n_sections, max(dominant_voice) AS dominant_voice FROM i JOIN m USING (conv_id) GROUP BY conv_id""")
def marked_record(spark, sf_dir):
    return songs(spark, sf_dir).select("artist", "title", "url", F.md5("lyrics_clean").alias("lyrics"), F.size("sections").alias("n_sections"), "dominant_voice")


@query("SELECT conv_id, turn, 'OTHER(group)' AS label, '<OTHER index=' || turn || ' speaker=group>' || chr(10) || 'x' || chr(10) || '</OTHER>' AS body, 'group' AS voice FROM conversations")
def section_defaults(spark, sf_dir):
    """Sections without type, speaker or order."""
    none = F.lit(None).cast("string")
    s = F.struct(none.alias("type"), F.col("turn").cast("int").alias("index"), none.alias("speaker"), F.lit(" x ").alias("text"), F.lit(None).cast("int").alias("order"))
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.array(s).alias("sections"), none.alias("artist"), F.concat_ws("/", "conv_id", "turn").alias("title"), none.alias("url"), none.alias("dominant_voice"))
    made = canonical.canonicalize(rows).select("title", F.col("structure").alias("label"), F.replace("canonical_text", F.lit("\n x"), F.lit("\nx")).alias("body"), F.col("dominant_voice").alias("voice"))
    keys = F.split("title", "/")
    return made.select(keys[0].cast("long").alias("conv_id"), keys[1].cast("long").alias("turn"), "label", "body", "voice")


_BROKEN = LINES.replace("string_split(text,", "string_split(replace(replace(text, ' of ', ' по-прежнему '), ' and ', ' по-преж '),")


@query(f"WITH {_BROKEN}, w AS (SELECT * FROM n WHERE NOT (contains(line, 'по-преж') AND NOT contains(line, 'по-прежнему'))), {_cap('w', 2)} {_joined('k')}")
def broken_form_filter(spark, sf_dir):
    """Two English words are made the broken form and the right one."""
    text = F.replace(F.replace(F.col("text"), F.lit(" of "), F.lit(" по-прежнему ")), F.lit(" and "), F.lit(" по-преж "))
    config = linefilter.FilterConfig(min_words_per_line=0, max_same_line_repeats=2, drop_latin_lines=False, drop_mixed_cyr_lat_words=False)
    return _lines_result(documents(spark, sf_dir), linefilter.clean_lines(lines(text), config))


# ---------------------------------------------------------------- choice, order, chat


@query("SELECT conv_id, text, CAST(length(text) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM conversations) WHERE place = 1")
def choose_best(spark, sf_dir):
    """The longest turn as the best of parallel arrays."""
    turns = conversations(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("c"))
    best = scoring.choose_best(F.col("c"), F.transform("c", lambda x: F.length(x).cast("double")))
    return turns.select("conv_id", best.alias("b")).select("conv_id", "b.text", "b.score")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def seeded_order(spark, sf_dir):
    return instruct.seeded_place(documents(spark, sf_dir).select("doc_id"), "42", "doc_id")


_HEAD = "'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || {env}'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10) || '<|eot_id|>'"
_TURN = "'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {body} || '<|eot_id|>'"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN {_TURN.format(role="'assistant'", body="'{\"name\": \"say\", \"parameters\": {\"text\": \"' || md5(text) || '\"}}'")}
 WHEN 'system' THEN {_TURN.format(role="'ipython'", body="'\"' || md5(text) || '\"'")} ELSE {_TURN.format(role='role', body="regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} END AS body FROM conversations)
SELECT conv_id, md5({_HEAD.format(env='')} || string_agg(body, '' ORDER BY turn) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS digest FROM t GROUP BY conv_id""")
def tool_calls(spark, sf_dir):
    """Assistants' turns as tool calls, systems' turns as tools' output, and a prompt for the next turn."""
    call = F.array(F.struct(F.lit("say").alias("name"), F.concat(F.lit('{"text": "'), F.md5("text"), F.lit('"}')).alias("arguments")))
    message = F.struct("turn", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "system", F.md5("text")).otherwise(F.col("text")).alias("content"), F.when(F.col("role") == "assistant", call).alias("tool_calls"))
    rows = conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", F.md5(chat.render(F.col("m"), generation_prompt=True, calls=True)).alias("digest"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role <> 'system')
SELECT conv_id, md5({_HEAD.format(env="'Environment: ipython' || chr(10) || ")} || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.' || chr(10) || chr(10)
 || 'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}.Do not use variables.' || chr(10) || chr(10) || '{{"f": 1}}' || chr(10) || chr(10) || max(body) FILTER (place = 1) || '<|eot_id|>'
 || coalesce(string_agg({_TURN.format(role='role', body='body')}, '' ORDER BY turn) FILTER (place > 1), '')) AS digest FROM t GROUP BY conv_id""")
def tool_list(spark, sf_dir):
    """Tools listed in the first message."""
    messages = chat.messages_of(conversations(spark, sf_dir).filter("role <> 'system'"), "conv_id")
    return messages.select("conv_id", F.md5(chat.render(F.col("messages"), tools=['{"f": 1}'])).alias("digest"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CAST(greatest(len(w) - 5, 0) AS INT) AS n, CAST(coalesce(list_sum(list_transform(w[6:], lambda x: length(x))), 0) AS BIGINT) AS total FROM w")
def strip_prompt(spark, sf_dir):
    """Lengths of words stand for ids, the first five for the prompt."""
    ids = F.transform(words(F.col("text")), lambda x: F.length(x))
    rest = documents(spark, sf_dir).select("doc_id", chat.strip_prompt(ids, F.lit(5)).alias("r"))
    return rest.select("doc_id", F.size("r").alias("n"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ---------------------------------------------------------------- generation


@query("SELECT 260 AS max_tokens, 0.8::DOUBLE AS temp, 0.9::DOUBLE AS top_p, 40 AS top_k, 0.06::DOUBLE AS min_p, 42 AS seed, 3 AS tries")
def sampling_defaults(spark, sf_dir):
    s = generate.Sampling()
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in vars(s).items()])


def stub_generator(prompt: str, sampling: generate.Sampling, seed: int) -> str:
    """Stands for a language model: tags as the prompt asks for, and one line more with each attempt; endings are too short at first."""
    tags = [x for x in prompt.split("\n") if x.startswith("<")]
    opened, closed = next(x for x in tags if not x.startswith("</")), next(x for x in tags if x.startswith("</"))
    step, attempt = divmod(seed - (999 if sampling.max_tokens == 300 else 0), 100)
    n = (4 if sampling.max_tokens == 300 else 1 if opened.startswith("<OUTRO") else 2) + attempt
    return "\n".join(["here it is", opened, *[f"шаг{step} строка{k} поёт{step} вновь{k}" for k in range(n)], closed])


GENERATED = """p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, CASE role WHEN 'system' THEN 'INTRO' WHEN 'user' THEN 'VERSE' ELSE 'OUTRO' END AS type FROM conversations),
q AS (SELECT *, CASE WHEN type = 'VERSE' THEN row_number() OVER (PARTITION BY conv_id, type ORDER BY step) END AS idx, CASE WHEN type = 'OUTRO' THEN 6 ELSE 4 END AS n FROM p),
l AS (SELECT conv_id, step, type, idx, unnest(range(n)) AS k FROM q),
s AS (SELECT conv_id, step, '<' || type || CASE WHEN idx IS NOT NULL THEN ' index=' || idx ELSE '' END || ' speaker=a>' || chr(10) || string_agg('шаг' || step || ' строка' || k || ' поёт' || step || ' вновь' || k, chr(10) ORDER BY k) || chr(10) || '</' || type || '>' AS section FROM l GROUP BY conv_id, step, type, idx)"""


@query(f"WITH {GENERATED} SELECT conv_id AS song_id, CAST(count(*) AS INT) AS n_sections, md5(string_agg(section, chr(10) || chr(10) ORDER BY step) || chr(10)) AS digest FROM s GROUP BY conv_id")
def generate_songs(spark, sf_dir):
    """Best of three for every section, the last two sections as context, endings tried again."""
    kinds = {**KINDS, "assistant": "OUTRO"}
    turns = conversations(spark, sf_dir).withColumn("s", F.concat(_mapped("role", kinds), F.lit("(a)")))
    plans = turns.groupBy(F.col("conv_id").alias("song_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), " > ").alias("structure"))
    songs_ = generate.SongWriter(stub_generator, generate.Sampling(seed=0)).write(plans.select("song_id", F.lit("night").alias("theme"), "structure"))
    return songs_.select("song_id", F.size("sections").alias("n_sections"), F.md5("text").alias("digest"))


@query("""WITH t AS (SELECT conv_id, string_split(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') || chr(10), chr(10)) AS ls FROM conversations GROUP BY conv_id), u AS (SELECT unnest(ls) AS line FROM t)
SELECT line, count(*) AS n FROM u GROUP BY line""")
def song_text_sink(spark, sf_dir):
    """Lines of the song files, turns as sections; each text ends in a line end of its own."""
    path = scratch_path(spark, "songs")
    turns = conversations(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    turns.select(generate.song_text(F.col("t"))).write.text(path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
