"""Expected values worked out by hand, on invented texts."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import canonical, chat, generate, instruct, linefilter, scoring, sections

SPEAKERS = {"ванёк": "ivan", "иван петров": "ivan", "пётр": "peter"}


def value(spark, column, **fields):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]) if fields else spark.range(1)
    return frame.select(column.alias("v")).head()[0]


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else tuple(x) if hasattr(x, "asDict") else x


@pytest.mark.parametrize(("header", "expected"), [
    ("Куплет 1: Имя", ("VERSE", 1, "Имя")),
    ("Припев", ("CHORUS", None, None)),
    ("куплет1", ("OTHER", None, None)),
    ("OUTRO 12 : a: b", ("OUTRO", 12, "a: b")),
    (" Бридж ", ("BRIDGE", None, None)),
    ("Verse 99999999999999999999", ("VERSE", None, None)),
])
def test_header(spark, header, expected):
    assert tuple(value(spark, sections.parse_header(F.lit(header)))) == expected


@pytest.mark.parametrize(("raw", "expected"), [(None, "group"), ("", "group"), ("feat. Ванек", "ivan"), ("  ИВАН   ПЕТРОВ ", "ivan"), ("Пётр и Ванёк", "ivan"), ("кто-то", "group"), ("ft.Петр", "peter")])
def test_speaker(spark, raw, expected):
    assert value(spark, sections.normalize_speaker(F.lit(raw).cast("string"), SPEAKERS)) == expected


def _sections(*speakers, texts=None):
    return F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit((texts or ["x"] * len(speakers))[i]).alias("text")) for i, s in enumerate(speakers)])


@pytest.mark.parametrize(("given", "expected"), [(["A", "group"], ["A", "A"]), (["unknown", "A", "group"], ["unknown", "A", "group"]), (["unknown", "group"], ["unknown", "unknown"]), (["group"], ["group"])])
def test_single_speaker(spark, given, expected):
    assert [s["speaker"] for s in value(spark, sections.infer_single_speaker(_sections(*given)))] == expected


def test_dominant_voice(spark):
    assert value(spark, sections.dominant_voice(_sections("A", "B", texts=["abc", "abc"]))) == "A"
    assert value(spark, sections.dominant_voice(_sections("A", "B", "B", texts=["abc", "ab", "cd"]))) == "B"
    assert value(spark, sections.dominant_voice(_sections("unknown", texts=["abc"]))) == "group"


def test_stitching_is_opt_in(spark):
    raw = "one\ntwo\n, three"
    assert value(spark, sections.clean_lyrics(F.lit(raw))) == raw
    assert value(spark, sections.clean_lyrics(F.lit("Несколько\nиждивенцев\n,\nа потом пришли другие"), stitched=True)) == "Несколько иждивенцев,\nа потом пришли другие"


SONG = """Описание
[Текст песни «Имя»]
начало
[Куплет 1: Ванёк]
раз
3 Contributors
[смех]

два


три
[Припев]
You might also like
четыре
[Аутро: Пётр]
"""


def test_split(spark):
    found = value(spark, sections.split_sections(F.lit(SONG), sections.Markup(SPEAKERS)))
    assert [tuple(s) for s in found] == [
        ("OTHER", None, "unknown", "начало", 0),
        ("VERSE", 1, "ivan", "раз\n\nдва\n\nтри", 1),
        ("CHORUS", None, "group", "четыре", 2),
    ]
    assert value(spark, sections.clean_lyrics(F.lit(SONG))) == "начало\nраз\n\nдва\n\nтри\nчетыре"
    assert value(spark, sections.split_sections(F.lit(None).cast("string"))) == []


def test_markup(spark):
    s = F.struct(F.lit("CHORUS").alias("type"), F.lit(2).alias("index"), F.lit("A").alias("speaker"), F.lit(" a \r\n\n\n\nb").alias("text"), F.lit(0).alias("order"))
    assert value(spark, canonical.section_label(s)) == "CHORUS(A)"
    assert value(spark, canonical.open_tag(s)) == "<CHORUS index=2 speaker=A>"
    assert value(spark, canonical.canonical_text(F.array(s))) == "<CHORUS index=2 speaker=A>\na\n\nb\n</CHORUS>"
    v = s.withField("type", F.lit("VERSE"))
    assert value(spark, canonical.section_label(v)) == "VERSE2(A)"
    assert value(spark, generate.open_tag(F.lit("CHORUS"), F.lit("A"), F.lit(2))) == "<CHORUS speaker=A>"


def test_sort_sections(spark):
    make = lambda order, index, name: F.struct(F.lit(order).cast("int").alias("order"), F.lit(index).cast("int").alias("index"), F.lit(name).alias("type"))
    given = F.array(make(None, None, "d"), make(1, None, "c"), make(1, 2, "b"), make(1, 1, "a"))
    assert [x["type"] for x in value(spark, canonical.sort_sections(given))] == ["a", "b", "c", "d"]


LOOSE = linefilter.FilterConfig(min_words_per_line=1, drop_latin_lines=False)


@pytest.mark.parametrize(("given", "config", "expected"), [
    (["x", "x", "x", "y", "x"], LOOSE, ["x", "x", "y", "x"]),
    (["x", "<V>", "x", "x", "x"], LOOSE, ["x", "<V>", "x", "x"]),
    (["раз два три", "abc раз два", " ", "раз  два три"], linefilter.FilterConfig(), ["раз два три", "раз два три"]),
    (["cлово раз два", "слово раз два"], linefilter.FilterConfig(drop_latin_lines=False), ["слово раз два"]),
    (["по-прежему он там", "по-прежнему он там"], linefilter.FilterConfig(), ["по-прежнему он там"]),
    (["x", "y y", "x"], linefilter.FilterConfig(2, 1, False), ["y y"]),
    (["<V>", "<V>", "<V>"], LOOSE, ["<V>", "<V>", "<V>"]),
    ([], LOOSE, []),
])
def test_clean_lines(spark, given, config, expected):
    lines = F.array(*map(F.lit, given)) if given else F.array().cast("array<string>")
    assert value(spark, linefilter.clean_lines(lines, config)) == expected


def test_tag_restore(spark):
    clean = lambda t: value(spark, linefilter.clean_section_text(F.lit(t), LOOSE))
    assert clean("preface\n<V a>\nx\n</V>") == "<V a>\npreface\n<V a>\nx\n</V>"
    assert clean("<V a>\nx\n</V>") == "<V a>\nx\n</V>"
    assert clean("x\ny") == "x\ny"
    assert value(spark, linefilter.clean_section_text(F.lit("<V a>\nx y z\n</V>"), linefilter.FilterConfig(keep_tag_lines=False, drop_latin_lines=False))) == "<V a>\nx y z\n</V>"
    assert value(spark, linefilter.clean_section_text(F.lit(None).cast("string"))) == ""
    assert tuple(value(spark, linefilter.extract_tagged_block(F.lit("a\n<V x>\n</A>\n</B>")))) == ("V", "<V x>", "</B>")


def test_score(spark):
    assert value(spark, scoring.score_section(F.lit(""))) == -1e9
    assert value(spark, scoring.score_section(F.lit("<V>\n</V>"))) == -1e9
    text = "раз два три четыре\nпять шесть семь восемь\nдевять десять сто двести"
    assert value(spark, scoring.score_section(F.lit(text))) == pytest.approx(7.1)
    assert value(spark, scoring.score_in_context(F.lit(text), F.lit("  "))) == pytest.approx(7.1)
    assert value(spark, scoring.score_in_context(F.lit(text), F.lit(text))) == pytest.approx(7.1 - 14)


def test_best(spark):
    best = lambda c, s: tuple(value(spark, scoring.choose_best(F.array(*map(F.lit, c)).cast("array<string>"), F.array(*map(F.lit, s)).cast("array<double>"))))
    assert best(["a", "b", "c"], [1.0, 2.0, 2.0]) == ("b", 2.0)
    assert best([], []) == ("", -1e18)


@pytest.mark.parametrize(("n", "valid"), [(0, 0), (5, 1), (19, 1), (40, 2)])
def test_split_sizes(spark, n, valid):
    rows = instruct.train_valid_split(spark.range(n), ("id",))
    assert rows.count() == n
    assert rows.filter("split = 'valid'").count() == valid


def test_group_split(spark):
    rows = spark.range(60).selectExpr("id", "id % 20 AS song")
    split = instruct.train_valid_split(rows, ("id",), group="song")
    assert split.count() == 60
    assert split.groupBy("song").agg(F.countDistinct("split").alias("k")).filter("k > 1").isEmpty()


def test_structure(spark):
    plan = value(spark, generate.parse_structure(F.lit("verse( A ) > chorus(b) >> Verse(c) > VERSE2(d)")))
    assert [tuple(p) for p in plan] == [("VERSE", "a", 1), ("CHORUS", "b", None), ("VERSE", "c", 2), ("VERSE2", "d", None)]
    plan = value(spark, generate.parse_structure(F.lit("VERSE(a) > VERSE2(d)"), numbered_types=True))
    assert [tuple(p) for p in plan] == [("VERSE", "a", 1), ("VERSE", "d", 2)]
    with pytest.raises(Exception, match="without parentheses"):
        value(spark, generate.parse_structure(F.col("s")), s="VERSE")


def test_blocks(spark):
    text = "<VERSE index=1 speaker=a>\nx\n</VERSE>\n\n<CHORUS>\ny\n</CHORUS>\n<HOOK speaker='b'>\nz\n</HOOK>"
    blocks = value(spark, instruct.extract_blocks(F.lit(text)))
    assert blocks == ["<VERSE index=1 speaker=a>\nx\n</VERSE>", "<HOOK speaker='b'>\nz\n</HOOK>"]
    assert [value(spark, instruct.block_speaker(F.lit(b), "q")) for b in [*blocks, "none"]] == ["a", "b", "q"]


def test_template(spark):
    message = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    text = value(spark, chat.render(F.array(message("user", " hi "), message("tool", 'a"b')), generation_prompt=True))
    head = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n<|eot_id|>"
    assert text == head + '<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|><|start_header_id|>ipython<|end_header_id|>\n\n"a\\"b"<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n'
    with_tools = value(spark, chat.render(F.array(message("system", "s"), message("user", "u")), tools=["{}"]))
    assert "Environment: ipython\n" in with_tools and with_tools.endswith("{}\n\nu<|eot_id|>")
    assert value(spark, chat.tool_call(F.lit("f"), F.lit('{"x": 1}'))).endswith('{"name": "f", "parameters": {"x": 1}}<|eot_id|>')
    assert value(spark, chat.strip_prompt(F.array(*map(F.lit, [1, 2, 3])), F.lit(2))) == [3]


@pytest.mark.parametrize("given", ["a\r\nb\rc\n", "a\x0bb\x0cc", "a\x85b c d", "", "\n", "a\n\nb"])
def test_lines_like_splitlines(spark, given):
    assert value(spark, T.lines(F.lit(given))) == given.splitlines()


@pytest.mark.parametrize("given", ["\t a  b\x1c ", "", "  ", "\x1fx"])
def test_strip_and_words(spark, given):
    assert value(spark, T.pstrip(F.lit(given))) == given.strip()
    assert value(spark, T.words(F.lit(given))) == given.split()


def test_runs(spark):
    assert value(spark, T.runs(F.array(*map(F.lit, ["a", "a", "b", "c", "c", "c"])))) == [2, 1, 3]
    assert value(spark, T.runs(F.array().cast("array<string>"))) == []


def test_template_with_calls(spark):
    call = "array(named_struct('name', 'f', 'arguments', '{}'))"
    message = lambda calls: F.expr(f"array(named_struct('role', 'assistant', 'content', cast(null as string), 'tool_calls', {calls}))")
    assert value(spark, chat.render(message(call), calls=True)).endswith('assistant<|end_header_id|>\n\n{"name": "f", "parameters": {}}<|eot_id|>')
    for bad in (f"concat({call}, {call})", f"slice({call}, 1, 0)"):
        with pytest.raises(Exception, match="exactly one tool call"):
            value(spark, chat.render(message(bad), calls=True))


def test_songs_are_written_step_by_step(spark, tmp_path):
    """Eight steps, and as many calls of the generator as there are candidates."""
    log = str(tmp_path / "calls")

    def generator(prompt, sampling, seed):
        with open(log, "a") as f:
            f.write(f"{seed}\n")
        tags = [x for x in prompt.split("\n") if x.startswith("<")]
        return "\n".join([tags[0], *[f"шаг{seed} строка{k} поёт вновь" for k in range(4)], next(x for x in tags if x.startswith("</"))])

    songs = spark.createDataFrame([(1, "t", " > ".join(["VERSE(a)"] * 8)), (2, None, "CHORUS(b)"), (3, "t", None)], "song_id long, theme string, structure string")
    rows = {r["song_id"]: r["sections"] for r in generate.SongWriter(generator, generate.Sampling(tries=2)).write(songs).collect()}
    assert [len(rows[k]) for k in (1, 2, 3)] == [8, 1, 0]
    assert rows[1][7].startswith("<VERSE index=8 speaker=a>\nшаг742 ")
    assert sorted(map(int, open(log))) == sorted([42 + 100 * k + t for k in range(8) for t in range(2)] + [42, 43])


@pytest.mark.parametrize("n", [1, 3, 50, 400])
def test_split_is_the_first_of_the_seeded_order(spark, n):
    import hashlib

    rows = instruct.train_valid_split(spark.range(n), ("id",)).collect()
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {r["id"] for r in rows if r["split"] == "valid"} == set(order[: max(1, int(n * 0.05))])


def test_previous_key(spark):
    from textloom.functions.ranks import previous_key

    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 2), ("a", 900), (None, 3), (None, 4), ("b", 7), ("b", None)], "g string, k long")
    found = sorted(map(tuple, previous_key(rows, "g", "k", 4).collect()), key=str)
    assert found == sorted([("a", 1, None), ("a", 2, 1), ("a", 5, 2), ("a", 900, 5), (None, 3, None), (None, 4, 3), ("b", 7, None)], key=str)


def test_running_total_keeps_clashing_columns(spark):
    from textloom.functions.ranks import running_total

    rows = spark.createDataFrame([(1, "k", 7, "b", None), (2, "j", 8, "c", 1)], "id int, key string, value int, bucket string, before int")
    found = {r["id"]: tuple(r) for r in running_total(rows, F.md5(F.col("id").cast("string")), F.lit(2), "total", ("id",)).collect()}
    assert sorted(x[-1] for x in found.values()) == [2, 4] and found[1][1:5] == ("k", 7, "b", None)


def test_empty_and_null_inputs(spark):
    """What the docstrings promise for nulls and empty tables."""
    null = F.lit(None).cast("string")
    assert value(spark, linefilter.clean_lines(F.lit(None).cast("array<string>"))) == []
    assert value(spark, sections.clean_lyrics(null)) == "" and value(spark, sections.split_sections(null)) == []
    assert value(spark, scoring.score_section(null)) == -1e9 and value(spark, scoring.line_overlap(null, null)) == 0
    songs = spark.createDataFrame([(None, None, None, None)], "artist string, title string, url string, lyrics string")
    marked = sections.mark_songs(songs)
    assert canonical.canonicalize(marked).head()["canonical_text"] == ""
    nothing = canonical.canonicalize(marked.withColumn("sections", F.lit(None).cast(marked.schema["sections"].dataType))).head()
    assert (nothing["structure"], nothing["canonical_text"], nothing["n_sections"], nothing["dominant_voice"]) == ("", "", 0, "group")
    empty = canonical.corpus_rows(canonical.canonicalize(sections.mark_songs(songs.limit(0))))
    assert empty.collect() == [] and instruct.build_dataset(empty, "title").collect() == []
    assert instruct.train_valid_split(empty, ("title",)).collect() == [] and chat.messages_of(spark.createDataFrame([], "c long, turn long, role string, text string"), "c").collect() == []
    assert scoring.ngram_matches(empty.select("title", "text"), "title", empty.select("artist", "text"), "artist").collect() == []
    assert scoring.best_candidate(spark.createDataFrame([], "g string, i int, score double, text string"), "g", "i").collect() == []
