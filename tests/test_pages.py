import json
import os
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from textloom.operators import canonical, sections
from textloom.sources import html, records
from textloom.streaming import ingest

PAGE = """<html><a href="/Pre-some-name-lyrics">x</a><a>none</a><A class=b HREF='/Pre-two-lyrics?x'><h3> A <b>title</b></h3></a>
<a href="/Pre-some-name-lyrics">again</a><a href="/Other-lyrics">o</a>
<div data-lyrics-container="true">[Verse]<br>one <i>two</i><br><br>three<script>no</script></div><div data-lyrics-container="true">&amp; four</div></html>"""
SELECTORS = [("div", "data-lyrics-container", "true"), ("div", "class", "lyrics")]


def test_text_of_containers():
    assert html.page_text(PAGE, SELECTORS) == "[Verse]\none\ntwo\nthree\n\n& four"
    assert html.page_text('<div class="a lyrics">x<br>y</div><div class="lyrics">z</div>', SELECTORS) == "x\ny"
    assert html.page_text("<p>x", SELECTORS) == ""
    assert html.page_text(None, SELECTORS) == ""


def test_texts_and_gate(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (None, "<div class=lyrics>" + "a" * 120)], "page_id long, html string")
    rows = {r["page_id"]: r for r in html.length_gate(html.extract_text(pages)).collect()}
    assert rows[1]["text"] == "[Verse]\none\ntwo\nthree\n\n& four" and rows[1]["status"] == html.TOO_SHORT
    assert rows[2]["text"] == "" and rows[2]["error"] is None
    assert rows[None]["status"] is None


def test_driver_pages_give_text(spark, sf):
    from textloom.plans import catalog

    rows = catalog.text_extract(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        assert r["error"] is None and r["text"]
        assert all(line.split()[0] in pages[r["page_id"]].replace("&amp;", "&") for line in r["text"].split("\n")[:1])


def test_song_index(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    rows = html.song_index(pages, "https://h.org/artists/x", "-lyrics", "Pre-").collect()
    assert sorted(map(tuple, rows)) == [("Atitle", "https://h.org/Pre-two-lyrics?x"), ("some name", "https://h.org/Pre-some-name-lyrics")]


@pytest.mark.parametrize("href", ["/a/b", "c", "http://x/y", "//h/z", "?q", "#f", "", "mailto:a"])
def test_resolve(spark, href):
    base = "https://example.org/list/index.html"
    row = spark.range(1).select(html.resolve(base, F.lit(href)).alias("a"), html.resolve_any(base, F.lit(href))["url"].alias("b"), html.url_path(html.resolve(base, F.lit(href))).alias("p")).head()
    assert row["a"] == row["b"] == urljoin(base, href)
    if row["a"].startswith("http"):
        assert row["p"] == urlparse(row["a"]).path.lstrip("/")


def test_todo_keeps_repeats_within_the_index(spark):
    index = spark.createDataFrame([(" a ", "u1"), ("b", "u2"), ("b", "u2"), ("c", " "), ("d", None)], "title string, url string")
    done = spark.createDataFrame([("u1",), (None,)], "url string")
    assert sorted(map(tuple, html.todo(index, done, "x").collect())) == [("x", "b", "u2"), ("x", "b", "u2")]


def test_records(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"title": "ё", "url": "u"}\n\n{"title": null, "url": "v"}\n')
    strict = records.read_strict(spark, path, records.INDEX)
    assert sorted(map(tuple, strict.collect()), key=str) == [("ё", "u"), (None, "v")] or strict.count() == 2
    records.write_jsonl(strict, str(tmp_path / "out"))
    lines = [line for f in os.listdir(tmp_path / "out") if f.endswith(".json") for line in open(tmp_path / "out" / f, encoding="utf-8")]
    assert {json.dumps(json.loads(x), ensure_ascii=False) for x in lines} == {'{"title": "ё", "url": "u"}', '{"title": null, "url": "v"}'}
    assert any("ё" in x for x in lines)
    with open(path, "a", encoding="utf-8") as f:
        f.write("broken\n")
    assert sorted(r["url"] for r in records.read_done(spark, path).collect()) == ["u", "v"]
    with pytest.raises(Exception):
        records.read_strict(spark, path, records.INDEX).collect()
    assert records.read_done(spark, str(tmp_path / "none")).count() == 0


def test_canonical_files(spark, tmp_path):
    raw = spark.createDataFrame([(None, "t", "u", "[Verse 1]\none two\n[Chorus]\nthree")], "artist string, title string, url string, lyrics string")
    done = canonical.canonicalize(sections.mark_songs(raw))
    assert records.write_canonical(done, str(tmp_path)) == 1
    text = "".join(open(tmp_path / "canonical_corpus.txt" / f, encoding="utf-8").read() for f in sorted(os.listdir(tmp_path / "canonical_corpus.txt")) if f.endswith(".txt"))
    assert text == "=== SONG ===\nTITLE: t\nURL: u\nARTIST: None\nDOMINANT_VOICE: group\nSTRUCTURE: VERSE1(group) > CHORUS(group)\n\n<VERSE index=1 speaker=group>\none two\n</VERSE>\n\n<CHORUS speaker=group>\nthree\n</CHORUS>\n=== END SONG ===\n\n"
    assert spark.read.schema(records.CORPUS).json(str(tmp_path / "canonical_corpus.jsonl")).count() == 1


def test_error_lines(spark):
    rows = spark.createDataFrame([("E", "u", "t", "ValueError: x"), (None, "v", "t", None)], "kind string, url string, title string, error string")
    assert [r[0] for r in records.error_lines(rows, "kind", detail="error").collect()] == ["E\tu\tt\tValueError: x"]


def test_stream_resumes(spark, tmp_path):
    body = lambda t: f'<div class="lyrics">{t * 150}</div>'
    write = lambda rows: spark.createDataFrame(rows, ingest.PAGES).write.mode("append").parquet(str(tmp_path / "pages"))
    run = lambda: ingest.follow(spark, str(tmp_path / "pages"), str(tmp_path / "songs"), str(tmp_path / "errors"), str(tmp_path / "ckpt"), "x").awaitTermination()
    write([(1, "u1", body("a")), (2, "u2", "short")])
    run()
    write([(3, "u1", body("b")), (4, "u3", body("c"))])
    run()
    songs = spark.read.schema(records.RAW).json(str(tmp_path / "songs")).collect()
    assert sorted((s["url"], s["lyrics"][0]) for s in songs) == [("u1", "a"), ("u3", "c")]
    assert [r[0].split("\t")[0] for r in spark.read.text(str(tmp_path / "errors")).collect()] == [html.TOO_SHORT]


@pytest.mark.parametrize("href", ["../x", "a/./b/../c", "a..b/c", "http://h.org:80/x y", "a:b", "/", "//h.org", "x.html/", "é/ü", "a//b", "..", "?", "/a/../b"])
def test_resolve_any(spark, href):
    base = "https://example.org/list/index.html"
    row = spark.range(1).select(html.resolve_any(base, F.lit(href)).alias("r")).head()["r"]
    assert (row["url"], row["error"]) == (urljoin(base, href), None)


def test_broken_references_and_pages(spark, monkeypatch):
    rows = spark.createDataFrame([("http://[bad",), (None,), ("ok",)], "href string").select("href", html.resolve_any("https://h.org/", F.col("href")).alias("r")).collect()
    assert [r["r"]["url"] for r in rows] == [None, None, "https://h.org/ok"] and rows[0]["r"]["error"].startswith("ValueError") and rows[1]["r"]["error"] is None
    found = html.parsed_links(spark.createDataFrame([(1, '<a href="x">'), (2, None)], "page_id long, html string")).collect()
    assert [(r["page_id"], r["pos"], r["href"], r["error"]) for r in found] == [(1, 0, "x", None)]


def test_first_seen_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([("u", 2, 0, "b"), ("u", 1, 5, None), ("v", None, 1, "c"), ("v", 0, 0, "d"), (None, 1, 1, "e")], "url string, page_id int, pos int, h3 string")
    assert sorted(map(str, map(tuple, html.first_seen(rows, "url", "page_id", "pos").collect()))) == sorted(map(str, [("u", 1, 5, None), ("v", None, 1, "c"), (None, 1, 1, "e")]))
    assert html.first_seen(rows.limit(0), "url", "page_id", "pos").columns == rows.columns


def test_repeated_batch_adds_nothing(spark, tmp_path):
    """A batch that comes again, whatever of it was written before, leaves one copy of its songs and error lines."""
    rows = spark.createDataFrame([(1, "u1", '<div class="lyrics">' + "a" * 150), (2, "u2", "short")], ingest.PAGES)
    songs, errors = str(tmp_path / "songs"), str(tmp_path / "errors")
    for batch in (0, 0, 1):
        ingest.append_new(rows, songs, errors, "x", batch=batch)
    assert [r["url"] for r in spark.read.schema(records.RAW).json(songs).collect()] == ["u1"]
    assert spark.read.text(errors).count() == 2  # the short page came in two batches
