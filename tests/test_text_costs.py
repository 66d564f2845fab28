"""What texts cost: how often a plan reads them, and that cheap forms give what plain Python gives."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import generate, linefilter, plain, scoring
from textloom.plans import catalog

ALPHABET = [*"abzAZ", *"абяАЯёЁ", *"09_-", *"<>/V", " ", "  ", "\t", "\x1f", "\xa0", "é", "\u3000", "\n", "\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\u2029"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_cleaning_splits_the_text_once(spark, sf):
    """the expression that makes the text was computed for the lines and again for the tags, a call for each letter dropped."""
    plan = catalog.tagged_section_clean(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1 and r" \n]+" in plan, plan


def test_classes_list_their_characters():
    """Java takes a call per character and range where a class has ranges."""
    for pattern in (T.LINE_END, linefilter.LATIN, linefilter.MIXED.replace(linefilter.CYRILLIC, "")):
        assert not re.search(r"[A-Za-z0-9]-[A-Za-z0-9]", pattern), pattern
    every = [chr(c) for c in range(0x500)]
    assert [c for c in every if re.match(linefilter.LATIN, c)] == [c for c in every if re.match("[A-Za-z]", c)]
    assert [c for c in every if re.match(linefilter.CYRILLIC, c)] == [c for c in every if re.match("[А-Яа-яЁё]", c)]


def test_space_is_that_of_python(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert sorted(T.SPACES) == [c for c in every if c.isspace()]
    given = [c + "a" + c for c in every if c.isspace() or c in "\u200b\ufeff\u180e\x00"] + texts(200, 1)
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", T.pstrip(F.col("t")).alias("s"), T.lines(F.col("t")).alias("l")).collect()
    for r in rows:
        assert (r["s"], r["l"]) == (r["t"].strip(), r["t"].splitlines())


def test_mixed_words(spark):
    given = texts(600, 2)
    for r in spark.createDataFrame([(t,) for t in given], "t string").select("t", linefilter.has_mixed_word(F.col("t")).alias("m")).collect():
        assert r["m"] == any(re.search("[А-Яа-яЁё]", w) and re.search("[A-Za-z]", w) for w in re.findall("[A-Za-zА-Яа-яЁё0-9_-]+", r["t"])), r["t"]


def test_a_filtered_value_is_computed_once(spark, sf):
    """a filter on the statistics was moved below them, and computed all of them once more."""
    for name in ("avg_words_uniq_ratio", "line_frequency_top3", "ngram4_repetition"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("coalesce(text") == 1 and "Filter" not in plan, plan


def test_letters_and_averages(spark):
    given = [*texts(300, 3), "Ёлка ёж", "ЀЂ Ґ", "x\ny\nx\nx\ny\nz\nw\nw"]
    columns = {"n": scoring.letter_counts(F.col("t")), "a": scoring.line_averages(F.col("t")), "s": scoring.line_statistics(F.col("t"))}
    for r in spark.createDataFrame([(t,) for t in given], "t string").select("t", *[c.alias(k) for k, c in columns.items()]).collect():
        assert tuple(r["n"]) == (len(re.findall("[А-Яа-яЁё]", r["t"])), len(re.findall("[A-Za-z]", r["t"])))
        assert tuple(r["a"]) == tuple(r["s"][k] for k in ("n_lines", "avg_words", "uniq_ratio"))


def test_scores_in_context_have_no_step_for_each_letter(spark, sf):
    """letters were extracted one by one, lines sorted by an interpreted comparison, each word hashed for four n-grams."""
    plan = catalog.score_in_context(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_sort" not in plan
    assert "transform(array_remove(split" in plan  # hashes of words, before those of n-grams


def test_contexts_like_plain_python(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["раз", "два", "three", "é"]) for _ in range(r.randint(0, 6)))
    given = [("\n".join(line() for _ in range(r.randint(0, 5))), "\n".join(line() for _ in range(r.randint(0, 5)))) for _ in range(200)]

    def parts(text):
        content = [x.strip() for x in text.splitlines() if x.strip()]
        words = " ".join(content).split()
        return set(content), {tuple(words[i : i + 4]) for i in range(len(words) - 3)}

    rows = spark.createDataFrame(given, "a string, b string").select("a", "b", scoring.score_section(F.col("a")).alias("s"), scoring.score_in_context(F.col("a"), F.col("b")).alias("c")).collect()
    for x in rows:
        (lines, grams), (before, grams_before) = parts(x["a"]), parts(x["b"])
        taken = 8 * len(lines & before) / max(1, len(lines)) + 6 * len(grams & grams_before) / max(1, len(grams))
        assert abs(x["c"] - (x["s"] - (taken if lines else 0))) < 1e-9


def test_plain_forms_give_what_columns_give(spark):
    """Scores are equal to the last bit, since candidates are compared by them."""
    r = random.Random(6)
    made = lambda: "\n".join(r.choice(["<V a>", "</V>", " <V b> ", "< V>", "раз два три", "раз  два три", "one two three", "по-преж мы тут", "по-прежнему мы", "сlово раз два", *texts(3, r.random())]) for _ in range(r.randint(0, 12)))
    given = [(made(), made()) for _ in range(150)] + [("", ""), ("<V>", "x"), ("<V x>\n</V>\n</W>", "")]
    rows = spark.createDataFrame(given, "a string, b string")
    for least, most, latin, mixed, tags, collapse in ((3, 2, True, True, True, True), (1, 1, False, True, True, False), (0, 3, False, False, False, True), (2, 0, False, True, False, False)):
        config = linefilter.FilterConfig(least, most, latin, mixed, tags, collapse)
        for x in rows.select("a", linefilter.clean_section_text(F.col("a"), config).alias("c")).collect():
            assert plain.clean_section_text(x["a"], config) == x["c"], (x["a"], config)
    for x in rows.select("a", "b", scoring.score_in_context(F.col("a"), F.col("b")).alias("s")).collect():
        assert plain.score_in_context(x["a"], plain.context(x["b"])) == x["s"], (x["a"], x["b"])
    assert plain.clean_section_text(None, linefilter.FilterConfig()) == ""


def test_prompts_are_those_of_columns(spark):
    steps = [("VERSE", "a", 2), ("OUTRO", "b", None), ("", "", None)]
    for theme in ("t", None):
        for context in ("", " \n", "x\n{theme}\n"):
            for kind, speaker, index in steps:
                columns = [F.lit(v).cast(t) for v, t in ((theme, "string"), (kind, "string"), (speaker, "string"), (index, "int"), (context, "string"))]
                assert generate._prompt(theme, {"type": kind, "speaker": speaker, "index": index}, context, generate.Wording()) == spark.range(1).select(generate.section_prompt(*columns).alias("p")).head()["p"]


def test_a_song_of_many_steps_takes_no_jobs_of_its_own(spark):
    """each step of the longest song was three jobs over all songs, and all songs were written anew."""
    written = []

    def materialize(df):
        written.append(df)
        return df

    def generator(prompt, sampling, seed):
        tags = [x for x in prompt.split("\n") if x.startswith("<")]
        return "\n".join([tags[0], *[f"шаг{seed} строка{k} поёт вновь" for k in range(4)], next(x for x in tags if x.startswith("</"))])

    songs = spark.createDataFrame([(1, "t", " > ".join(["VERSE(a)"] * 400)), (2, "t", ""), (3, "t", "OUTRO(b)"), (2**60 + 1, None, "CHORUS(b)"), (None, "t", "CHORUS(b)")], "song_id long, theme string, structure string")
    rows = {x["song_id"]: x["sections"] for x in generate.SongWriter(generator, materialize=materialize).write(songs).collect()}
    assert {k: len(v) for k, v in rows.items()} == {1: 400, 2: 0, 3: 1, 2**60 + 1: 1, None: 1} and len(written) == 1
    assert rows[1][399].startswith("<VERSE index=400 speaker=a>\nшаг39942 ")


def test_songs_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(generate, "BATCH", 50)
    run = generate._songs(lambda p, s, seed: f"раз два три {seed}", generate.Sampling(tries=1), generate.Wording(), linefilter.FilterConfig(), 2)
    plan = [{"type": "CHORUS", "speaker": "a", "index": None}]
    batch = pa.RecordBatch.from_pydict({"song_id": list(range(9)), "theme": ["t"] * 9, "plan": [plan * (k % 4) for k in range(8)] + [None]})
    out = [x for b in run(iter([batch, batch.slice(0, 0)])) for x in b.to_pylist()]
    assert [x["song_id"] for x in out] == list(range(9)) and [len(x["sections"]) for x in out] == [0, 1, 2, 3, 0, 1, 2, 3, 0]
