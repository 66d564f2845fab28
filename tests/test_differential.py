"""Operators against short restatements in plain Python, on random texts; and properties."""

import random
from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import canonical, generate, instruct, linefilter, scoring, sections

WORDS = ["раз", "два", "три", "one", "two", "сlово", "по-преж", "a-b", "x", " "]


def texts(n, seed, lines):
    r = random.Random(seed)
    return ["\n".join(r.choice(lines)(r) for _ in range(r.randint(0, 9))) for _ in range(n)]


def some_words(r):
    return r.choice(["", " ", "\t"]).join([" ".join(r.choice(WORDS) for _ in range(r.randint(0, 5)))] * r.randint(1, 2))


def plain_clean(text, least, most, latin):
    import re

    out, last, count = [], None, 0
    for line in (re.sub(r"\s+", " ", x.strip()) for x in text.splitlines()):
        if not line:
            continue
        if re.fullmatch(r"<([A-Z]+)[^>]*>|</[A-Z]+>", line):
            out.append(line)
            last, count = line, 0
            continue
        mixed = any(re.search("[А-Яа-яЁё]", w) and re.search("[A-Za-z]", w) for w in re.findall("[A-Za-zА-Яа-яЁё0-9_-]+", line))
        if (latin and re.search("[A-Za-z]", line)) or mixed or ("по-преж" in line and "по-прежнему" not in line) or len(line.split()) < least:
            continue
        count = count + 1 if line == last else 0
        last = line
        if count and count >= most:
            continue
        out.append(line)
    return out


def test_clean_lines(spark):
    given = texts(120, 1, [some_words, some_words, lambda r: "<V a>", lambda r: "</V>"])
    for least, most, latin in ((3, 2, True), (1, 1, False), (0, 3, False), (2, 0, False)):
        config = linefilter.FilterConfig(least, most, latin)
        rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", linefilter.clean_lines(linefilter.lines(F.col("t")), config).alias("c")).collect()
        for r in rows:
            assert r["c"] == plain_clean(given[r["i"]], least, most, latin), (given[r["i"]], least, most)


def test_cleaning_is_idempotent(spark):
    given = texts(60, 2, [some_words])
    config = linefilter.FilterConfig(1, 2, False)
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    once = rows.select(linefilter.clean_section_text(F.col("t"), config).alias("a"))
    for r in once.select("a", linefilter.clean_section_text(F.col("a"), config).alias("b")).collect():
        assert r["a"] == r["b"]


def plain_statistics(text):
    content = [x.strip() for x in text.splitlines() if x.strip()]
    words = " ".join(content).split()
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    counts = Counter(content)
    return len(content), max(counts.values(), default=0), sum(sorted(counts.values())[-3:]), (len(grams) - len(set(grams))) / max(1, len(grams))


def test_statistics(spark):
    given = texts(80, 3, [some_words])
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", scoring.line_statistics(F.col("t")).alias("s")).collect()
    for r in rows:
        s = r["s"]
        assert (s["n_lines"], s["max_repeat"], s["top3"]) == plain_statistics(given[r["i"]])[:3]
        assert abs(s["repetition"] - plain_statistics(given[r["i"]])[3]) < 1e-12


def test_render_and_parse_are_inverse(spark):
    r = random.Random(4)
    songs = [[(r.choice(list(sections.TYPES)), r.choice([None, 1, 12]), r.choice(["a", "b"]), r.choice(["x y", "x\n\ny", "é"]), i) for i in range(r.randint(1, 5))] for _ in range(30)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(songs)], f"i int, s array<{sections.SECTION}>")
    for row in rows.select("i", canonical.parse_canonical(canonical.canonical_text(F.col("s"))).alias("p")).collect():
        assert [tuple(x) for x in row["p"]] == [s[:4] for s in songs[row["i"]]]


def test_draws_do_not_depend_on_partitioning(spark):
    corpus = spark.range(50).selectExpr("CAST(id AS STRING) AS title", "'V(a)' AS structure", "'<V a>\nx\n</V>\n\n<CHORUS speaker=b>\ny\n</CHORUS>' AS text")
    one, many = (sorted(map(str, instruct.build_dataset(corpus.repartition(n), "title").collect())) for n in (1, 7))
    assert one == many and len(one) > 100


def test_song_writer(spark):
    def generator(prompt, sampling, seed):
        if "<OUTRO" in prompt and sampling.tries == 3 and sampling.max_tokens == 260:
            return "<OUTRO speaker=c>\nкороткий конец песни\n</OUTRO>"
        tag = next(x for x in prompt.split("\n") if x.startswith("<"))
        lines = [f"строка номер {w}" for w in ("раз", "два", "три", "пять")][: 4 if seed % 100 != 1 else 2]
        return "\n".join([tag, *lines, "</" + tag[1:].split()[0] + ">"])

    songs = spark.createDataFrame([(1, "т", "VERSE(a) > CHORUS(b) > OUTRO(c)"), (2, "т", "VERSE(a)")], "song_id long, theme string, structure string")
    rows = {r["song_id"]: r for r in generate.SongWriter(generator).write(songs).collect()}
    assert len(rows[1]["sections"]) == 3 and len(rows[2]["sections"]) == 1
    assert rows[1]["sections"][0].startswith("<VERSE index=1 speaker=a>\n") and rows[1]["sections"][0].count("\n") == 5
    assert rows[1]["sections"][2].count("строка") == 4  # the second attempt at the ending
    assert rows[2]["text"].endswith("</VERSE>\n")
