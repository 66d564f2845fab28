"""Media, WARC, token counts and pieces."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import media, piece_lattice, registry, token_cache, warc
from textloom.tables import scratch_path

TEXTS = ["", "a", "x" * 64, "y" * 65, "né 日本\n" * 500, "\x00\xff" * 2000, "one\ttwo  three <|endoftext|>four", "I'll don't\r\n  123 ² x\u0085y"]


def test_movies_are_lossless():
    payloads = [media.payload_of(t.encode()) for t in TEXTS] + [bytes(random.Random(1).randbytes(64 * 50))]
    assert [len(p) % 64 for p in payloads] == [0] * len(payloads) and len(payloads[0]) == 64
    movies = media.encode_payloads(payloads)
    for p, (found, samples) in zip(payloads, media.read_samples(movies), strict=True):
        assert media.stored_payload(found, samples) == p
    _, frames = media.parse_avi(movies[4])
    pixels = media.decode_jpeg(frames[0])
    assert pixels.shape == (128, 512) and (media.block_means(pixels) == media.decode_fixed(frames[:1])[0]).all()


def encode(pixels, quality=1):
    """A baseline encoder with its own tables, for the decoder: grey or three components, restart intervals."""
    planes = [pixels] if pixels.ndim == 2 else [pixels[..., k] for k in range(3)]
    size = planes[0].shape
    codes = {s: (8, s) for s in range(12)} | {}
    ac = {(r << 4 | s): (8, i) for i, (r, s) in enumerate((r, s) for r in range(16) for s in range(11))}
    table = lambda kind, c: media._segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(c)] + [0] * 8) + bytes(sorted(c, key=lambda s: c[s][1])))
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [quality] * 64)) + media._segment(0xC0, bytes([8]) + size[0].to_bytes(2, "big") + size[1].to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([k + 1, 17, 0]) for k in range(len(planes))))
    head += table(0, codes) + table(16, ac) + media._segment(0xDD, (2).to_bytes(2, "big")) + media._segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + bytes([0, 63, 0]))
    out, bits, before = b"", "", [0] * len(planes)
    number = lambda v, s: format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""
    flush = lambda b: int((b + "1" * (-len(b) % 8)) or "0", 2).to_bytes(-(-len(b) // 8), "big").replace(b"\xff", b"\xff\x00")
    blocks = [(y, x) for y in range(0, size[0], 8) for x in range(0, size[1], 8)]
    for n, (y, x) in enumerate(blocks):
        if n and n % 2 == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (n // 2 - 1) % 8])
            bits, before = "", [0] * len(planes)
        for k, p in enumerate(planes):
            square = media._basis() @ (p[y : y + 8, x : x + 8].astype(float) - 128) @ media._basis().T
            z = np.rint(square.ravel()[media.ZIGZAG] / quality).astype(int)
            d, before[k] = z[0] - before[k], z[0]
            s = int(abs(d)).bit_length()
            bits += format(codes[s][1], "08b") + number(int(d), s)
            run = 0
            for v in z[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += format(ac[0xF0][1], "08b")
                    run -= 16
                s = int(abs(v)).bit_length()
                bits += format(ac[run << 4 | s][1], "08b") + number(int(v), s)
                run = 0
            if run:
                bits += format(ac[0][1], "08b")
    return head + out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("shape", [(16, 24), (8, 8), (16, 16, 3)])
def test_general_decoder(shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    pixels = (128 + 80 * np.sin(y / 5) * np.cos(x / 7)).astype(np.uint8)
    pixels = np.stack([pixels, 255 - pixels, pixels // 2], -1) if len(shape) == 3 else pixels
    back = media.decode_jpeg(encode(pixels))
    if len(shape) == 2:
        assert np.abs(back.astype(int) - pixels).max() <= 1
    else:
        y, cb, cr = (pixels[..., k].astype(float) for k in range(3))
        rgb = np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1), 0, 255)
        assert np.abs(back - rgb).max() <= 4


def test_shots_and_broken_files(spark):
    dark, light = np.full((12, media.FRAME), 10, np.uint8), np.full((8, media.FRAME), 200, np.uint8)
    movie = media.write_avi(media.encode_frames(np.concatenate([dark, light])), 512, 128)
    rows = spark.createDataFrame([(1, movie), (2, b"RIFF nothing"), (3, None), (4, movie[:400])], "id long, film binary")
    found = [tuple(r) for r in media.clip_table(rows, "id", "film").orderBy("media_id", "clip").collect()]
    assert found[:2] == [(1, 0, 0, 12, 0.0, 0.48, None), (1, 1, 12, 8, 0.48, 0.8, None)]
    assert [r[0] for r in found[2:]] == [2, 3] and all(r[6] for r in found[2:]) or len(found) == 5
    unindexed = movie[: movie.rfind(b"idx1")]
    assert len(media.parse_avi(unindexed)[1]) == 20


def test_media_digests(spark):
    rows = media.op2_avi_mjpeg(spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")).collect()
    for r in rows:
        data = ([*TEXTS, None][r["doc_id"]] or "").encode()
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[0]["media_sha256"] == rows[len(TEXTS)]["media_sha256"]


def record(body, **headers):
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_salvage_plain():
    good = [record(f"HTTP/1.1 200 OK\r\n\r\n{i}".encode(), **{"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}) for i in range(4)]
    bad = record(b"changed", **{"WARC-Block-Digest": "sha1:" + hashlib.sha1(b"other").hexdigest()})
    data = b"junk" + good[0] + bad + good[1] + good[2][:-20] + good[3] + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"
    found = warc.scan(data)
    assert [r.headers["warc-record-id"] for r in found.records] == ["<0>", "<1>", "<3>"]
    assert [g.reason for g in found.gaps] == ["no version line", "block digest differs", "record does not end with CRLF CRLF", "record is truncated"]
    assert sum(g.end - g.offset for g in found.gaps) + sum(r.end - r.offset for r in found.records) == len(data)
    assert warc.scan(b"").records == [] and warc.scan(b"\x1f\x8b").gaps


def test_salvage_gzip():
    parts = [gzip.compress(record(f"HTTP\r\n\r\n{i}".encode() * 50, **{"WARC-Record-ID": f"<{i}>"})) for i in range(4)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + bytes(broken) + parts[2] + b"\0\0" + parts[3][:-5]
    found = warc.scan(data)
    assert [r.headers["warc-record-id"] for r in found.records] == ["<0>", "<2>"]
    assert len(found.gaps) == 2


def test_archives_hold_payloads(spark):
    long = "<p>é</p>" * 200
    pages = [(1, "u\r\nX: y", long), (5, "v", long), (2, "w", "short"), (3, "w", "short"), (4, None, None), (6, "x", "WARC/1.1\r\nContent-Length: 1\r\n\r\nz")]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = warc.read_archives(spark, path).collect()
    assert not [r for r in rows if r["kind"] == "gap"] and len(rows) == 6
    html = {p[0]: (p[2] or "").encode() for p in pages}
    for r in rows:
        page = int(r["record_id"][10:-1])
        assert r["payload_digest"] == hashlib.sha1(html[page]).hexdigest() and r["payload_bytes"] == len(html[page])
        assert r["record_type"] == ("revisit" if page == 1 else "response")
        assert r["payload"] == (None if page == 1 else html[page])


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.BYTE_BPE)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "cache-test")
    first = token_cache.count_tokens(docs, registry.BYTE_BPE, path).collect()
    for r in first:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False)) and r["n_bytes"] == len(text.encode())
    stored = spark.read.parquet(path)
    assert stored.count() == len(set(TEXTS))
    token_cache.count_tokens(docs, registry.BYTE_BPE, path).collect()
    assert spark.read.parquet(path).count() == len(set(TEXTS))  # nothing was missing
    more = spark.createDataFrame([(1, "something new")], "doc_id long, text string")
    assert token_cache.count_tokens(more, registry.BYTE_BPE, path).head()["n_tokens"] == len(library.encode("something new").ids)
    assert spark.read.parquet(path).count() == len(set(TEXTS)) + 1


def paths(model, word):
    """Scores of all segmentations of a word."""
    if not word:
        return [0.0]
    return [s + x for k in range(1, len(word) + 1) if word[:k] in model.pieces for s in [model.pieces[word[:k]][1]] for x in paths(model, word[k:])]


def test_pieces_against_all_segmentations():
    coder = piece_lattice.Encoder(registry.PIECES)
    for word in ["▁the", "▁hello", "ing", "▁aaa", "▁Stadt", ",", "▁x.y"]:
        every = sorted(paths(coder.model, word), reverse=True)
        assert [s for s, _ in coder.model.nbest(word, 6)] == every[:6]
        assert coder.model.best(word)[0] == every[0]
        score, ids, cost = coder.model.best_many([word])[0]
        assert score == every[0] and (cost == every[0] - every[1] if len(every) > 1 else cost == float("inf"))
        assert sum(coder.model.pieces[coder.model.text[i]][1] for i in ids) == score


def test_texts_encode_and_decode():
    coder = piece_lattice.Encoder(registry.PIECES)
    texts = ["Hello,  wörld\n\tx 日本 123", "", " a", "the the thing", "😀\x00", "a_b²c"]
    for text, (ids, score, tops) in zip(texts, coder.encode(texts), strict=True):
        assert coder.model.decode(ids.tolist()) == text.encode()
        whole = coder.nbest(text)
        assert [s for s, _ in whole] == pytest.approx([t for t, _ in tops]) and whole[0][0] == pytest.approx(score)
        assert all(coder.model.decode(x) == text.encode() for _, x in whole)


def test_library_agrees_on_pieces():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)
    coder = piece_lattice.Encoder(registry.PIECES)
    for text in TEXTS[1:5]:
        ids = next(coder.encode([text]))[0].tolist()
        assert library.decode(ids) == text or "\x00" in text
        assert set(ids) <= set(range(library.get_piece_size()))


def test_one_tie_rule_on_all_paths():
    """Blocks, single words and A* pick the same ids, whatever the words' length and characters."""
    coder, r = piece_lattice.Encoder(registry.PIECES), random.Random(3)
    words = ["▁Llll", ".%%%", "%%%", "$$$$", "▁aaaaaaa", "lllllllllll"] + ["▁" * r.randrange(2) + "".join(r.choices("aelrtn%$.#", k=r.randint(1, 14))) for _ in range(3000)]
    words = sorted(set(words))
    many = coder.model.best_many(words)
    for word, (score, ids, _) in zip(words, many, strict=True):
        assert (score, ids) == coder.model.best(word)[:2], word
        assert (score, ids) == coder.model.nbest(word, 3)[0], word
    # The same characters inside a word that takes the other path.
    long = "x" * 39
    assert coder.model.best_many(["%%%%%", long + "%%%"])[1][1] == coder.model.best(long + "%%%")[1]


def test_edits_are_the_n_best_of_the_text(spark):
    coder = piece_lattice.Encoder(registry.PIECES)
    texts = ["one two three", "Llll %%% lllll", "a", "né 日本 ☃", "the end. " * 30, ""]
    for text, (ids, score, tops) in zip(texts, coder.encode(texts), strict=True):
        whole = coder.nbest(text)
        assert [t for t, _ in tops] == pytest.approx([s for s, _ in whole]) and tops[0] == (score, [])
        made = [piece_lattice.Edit.apply(e, ids).tolist() for _, e in tops]
        assert made[0] == ids.tolist() == whole[0][1] and len(set(map(tuple, made))) == len(made)
        own = {tuple(s): round(t, 6) for t, s in coder_all(coder, text)}
        for m, (t, edits) in zip(made, tops, strict=True):
            assert own[tuple(m)] == round(t, 6)
            assert coder.model.decode(m) == coder.model.decode(ids.tolist()) and all(e.same for e in edits)
    rows = piece_lattice.encode_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), registry.PIECES).collect()
    for row in rows:
        best = np.array(row["piece_ids"], np.int32)
        assert len(row["nbest_edits"]) == len(row["nbest_scores"]) == len(row["nbest_sha256"]) and row["round_trip"]
        for edits, digest in zip(row["nbest_edits"], row["nbest_sha256"], strict=True):
            made = piece_lattice.Edit.apply([piece_lattice.Edit(e["first"], e["size"], tuple(e["ids"]), True) for e in edits], best)
            assert hashlib.sha256(made.tobytes()).hexdigest() == digest


def coder_all(coder, text):
    """Segmentations of a text whose words have one of their own sixteen best, one or two words changed."""
    words = coder.words(text) if text else []
    lists = [coder.model.nbest(w, 16) for w in words]
    best = [x[0] for x in lists]
    changes = [(w, k) for w, x in enumerate(lists) for k in range(1, len(x))]
    for some in [(), *[(c,) for c in changes], *[(a, b) for a in changes for b in changes if a[0] < b[0]][:40_000]]:
        pick = {w: lists[w][k] for w, k in some}
        chosen = [pick.get(w, b) for w, b in enumerate(best)]
        yield sum(s for s, _ in chosen), [i for _, x in chosen for i in x]


def test_hot_digest_is_salted(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_cache, "HOT", 0.1)
    texts = ["the same text"] * 40 + [f"text {i}" for i in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = token_cache.op5_digest_token_counts(docs, registry.BYTE_BPE).collect()
    library = Tokenizer.from_file(registry.BYTE_BPE)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert len(rows) == len(texts)


@pytest.mark.parametrize("change", [lambda f: f.replace(b"\xff\xc0\x00\x0b\x08", b"\xff\xc0\x00\x0b\x08\xff\xff\xff\xff", 1), lambda f: f[: len(f) // 2], lambda f: b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x00\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x00\xff\xd9", lambda f: b""])
def test_broken_pictures_stay_in_their_row(spark, change):
    movie = media.encode_payloads([media.payload_of(b"text" * 50)])[0]
    frame = media.parse_avi(movie)[1][0]
    bad = media.write_avi([change(frame)], 8, 8)
    rows = media.clip_table(spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(movie)), (3, None)], "doc_id long, media binary"), "doc_id", "media").collect()
    found = {r["media_id"]: r["error"] for r in rows}
    assert found[2] is None and found[3] and len(rows) == 3


def test_further_riff_chunks():
    frames = [media.parse_avi(media.encode_payloads([media.payload_of(t)])[0])[1][0] for t in (b"one", b"two", b"three")]
    first = media.write_avi(frames[:1], 8, 8)
    more = b"".join(media._chunk(b"RIFF", b"AVIX" + media._list(b"movi", media._chunk(b"00dc", f))) for f in frames[1:])
    assert media.parse_avi(first + more)[1] == frames


def test_long_headers_are_read(spark):
    pages = spark.createDataFrame([(1, "http://h.org/" + "u" * 200_000, "<p>x"), (2, "u", None)], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    rows = warc.op7_warc_salvage(pages, path).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in rows) == [(1, 4), (2, 0)]
    assert warc.read_archives(spark, path).filter("kind = 'gap'").count() == 0


def test_header_that_does_not_end():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    found = warc.scan(b"WARC/1.1\r\nWARC-Type: response\r\nContent-" + record + record)
    assert len(found.records) == 2 and [(g.offset, g.reason) for g in found.gaps] == [(0, "header block does not end")]
