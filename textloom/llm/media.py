"""AVI motion-JPEG columns: a RIFF reader, a baseline JPEG decoder for intra frames, shot detection by adaptive histogram
differences, and a writer that stores bytes losslessly as the means of 8x8 blocks.

The writer's Huffman table gives a difference of category s a code of 9 - s bits and s further bits: every sample takes
9 bits and its block's end 1. Such fixed-width scans are ordinary baseline JPEG, and decode by table lookup for all frames
of a batch at once; any other scan goes through the general decoder.

Defined results: a null or empty text is one payload of 64 zero bytes; equal texts give equal files and features; broken
files give no frames (`parse_avi` raises MediaError, the clip operator returns one row with the reason); an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import tokens

UNIT = 64
#: Samples (8x8 blocks) of a frame across and down.
COLUMNS, ROWS = 64, 16
FRAME = COLUMNS * ROWS
FPS = 25
BINS = 16
#: A cut is a histogram difference above mean + SPREAD deviations of the WINDOW differences before it, and above FLOOR.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.25

#: Zigzag order of a block's coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


class MediaError(ValueError):
    """The bytes are not a readable AVI or JPEG."""


# ---------------------------------------------------------------- JPEG


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    """Everything of a frame before its scan's data: quantization 8 for means, fixed-width Huffman codes, one component."""
    quantization = bytes([0, 8]) + bytes([1]) * 63
    means = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    rest = bytes([16]) + bytes([1] + [0] * 15) + bytes([0])
    return b"\xff\xd8" + _segment(0xDB, quantization) + _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 17, 0)) + _segment(0xC4, means) + _segment(0xC4, rest) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


HEAD = _head(COLUMNS * 8, ROWS * 8)


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """10-bit code of each difference -255 to 255, and the difference of each code (999: not a code)."""
    codes, back = np.zeros(511, np.uint64), np.full(1024, 999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        code = (prefix << s | (d if d >= 0 else d + (1 << s) - 1)) << 1
        codes[d + 255], back[code] = code, d
    return codes, back


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(frames, FRAME) samples as JPEG frames."""
    codes, _ = _codes()
    level = samples.astype(np.int16) - 128
    step = np.diff(level, axis=1, prepend=np.int16(0))
    c = codes[step + 255].reshape(len(samples), FRAME // 4, 4)
    packed = (c[:, :, 0] << np.uint64(30) | c[:, :, 1] << np.uint64(20) | c[:, :, 2] << np.uint64(10) | c[:, :, 3]) << np.uint64(24)
    raw = np.ascontiguousarray(packed.astype(">u8")).view(np.uint8).reshape(len(samples), FRAME // 4, 8)[:, :, :5].reshape(len(samples), -1)
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in raw]


def decode_fixed(frames: list[bytes]) -> np.ndarray:
    """Samples of frames that begin with HEAD: (frames, FRAME)."""
    _, back = _codes()
    data = b"".join(f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames)
    if len(data) != len(frames) * FRAME // 4 * 5:
        raise MediaError("scan has another length")
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5).astype(np.uint64)
    packed = raw[:, 0] << np.uint64(32) | raw[:, 1] << np.uint64(24) | raw[:, 2] << np.uint64(16) | raw[:, 3] << np.uint64(8) | raw[:, 4]
    c = np.stack([packed >> np.uint64(k) & np.uint64(1023) for k in (30, 20, 10, 0)], 1)
    step = back[c.astype(np.int64)].reshape(len(frames), FRAME)
    if (step == 999).any():
        raise MediaError("scan has an unknown code")
    return (np.cumsum(step, axis=1, dtype=np.int32) + 128).astype(np.uint8)


@lru_cache(1)
def _basis() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


class _Bits:
    """Bits of a scan's data, most significant first; ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def drop(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1
        if self.at > len(self.data) + 64:
            raise MediaError("scan is truncated")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek(n)
        self.drop(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _symbol(bits: _Bits, table: dict[tuple[int, int], int]) -> int:
    for length in range(1, 17):
        code = bits.peek(length)
        if (length, code) in table:
            bits.drop(length)
            return table[length, code]
    raise MediaError("scan has an unknown code")


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels of a baseline JPEG: (height, width) grey or (height, width, 3) RGB."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no JPEG start")
    at, quantization, tables, parts, interval, size = 2, {}, {}, [], 0, (0, 0)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise MediaError("no JPEG marker")
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantization[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise MediaError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            uses = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            return _scan(data[at:], size, parts, uses, quantization, tables, interval)
    raise MediaError("no JPEG scan")


def _scan(data: bytes, size, parts, uses, quantization, tables, interval) -> np.ndarray:
    height, width = size
    if not parts or not height or not width or not all(h and v for _, h, v, _ in parts):
        raise MediaError("picture without size or parts")
    pieces = re.split(rb"\xff[\xd0-\xd7]", data[: data.rfind(b"\xff\xd9")] if b"\xff\xd9" in data else data)
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    # A block takes two codes of one bit at least: sizes that the scan cannot fill are not allocated.
    if across * down * sum(h * v for _, h, v, _ in parts) > 4 * len(data):
        raise MediaError("scan is truncated")
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in parts]
    basis, before, bits = _basis(), [0] * len(parts), _Bits(pieces.pop(0).replace(b"\xff\x00", b"\xff"))
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            if not pieces:
                raise MediaError("scan is truncated")
            before, bits = [0] * len(parts), _Bits(pieces.pop(0).replace(b"\xff\x00", b"\xff"))
        y0, x0 = divmod(unit, across)
        for k, (name, h, v, q) in enumerate(parts):
            dc, ac = tables[uses[name] >> 4], tables[16 | uses[name] & 15]
            for b in range(h * v):
                block = np.zeros(64)
                before[k] += bits.signed(_symbol(bits, dc))
                block[0], i = before[k], 1
                while i < 64:
                    run, s = divmod(_symbol(bits, ac), 16)
                    if not s and run != 15:
                        break
                    i += run
                    if i > 63:
                        raise MediaError("block is too long")
                    block[i] = bits.signed(s)
                    i += 1
                square = np.zeros(64)
                square[ZIGZAG] = block * quantization[q]
                y, x = (y0 * v + b // h) * 8, (x0 * h + b % h) * 8
                planes[k][y : y + 8, x : x + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
    full = [np.repeat(np.repeat(p, most_v // v, 0), most_h // h, 1)[:height, :width] for p, (_, h, v, _) in zip(planes, parts, strict=True)]
    if len(full) == 1:
        return np.clip(np.rint(full[0]), 0, 255).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    # Colour conversion of JFIF.
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- AVI


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, note: str = "") -> bytes:
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    info = _list(b"INFO", _chunk(b"ICMT", note.encode())) if note else b""
    body = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture))) + info + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def parse_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """Properties and video frames of an AVI. Frames of the first movie list come by the index, without a right one by walking
    the list; those of further RIFF chunks (`AVIX`, which the index does not cover) by walking their lists."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no AVI")
    found = {"fps": float(FPS), "note": ""}
    movies, index = [], b""

    def walk(at: int, end: int) -> None:
        nonlocal index
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movies.append((body, min(body + size, end)))
                else:
                    walk(body + 4, min(body + size, end))
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack("<II", data[body + 20 : body + 28])
                found["fps"] = rate / scale if scale and rate else found["fps"]
            elif name == b"ICMT":
                found["note"] = data[body : body + size].decode("utf-8", "replace")
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + (size & 1)

    top = 0
    while data[top : top + 4] == b"RIFF" and top + 12 <= len(data):
        size = int.from_bytes(data[top + 4 : top + 8], "little")
        walk(top + 12, min(len(data), top + 8 + size))
        top += 8 + size + (size & 1)
    if not movies:
        raise MediaError("no movie list")
    return found, (_indexed(data, movies[0], index) or _walked(data, *movies[0])) + [f for m in movies[1:] for f in _walked(data, *m)]


def _indexed(data: bytes, movie: tuple[int, int], index: bytes) -> list[bytes]:
    """Frames by idx1; none where an entry does not fit."""
    for base in (movie[0], 0):  # offsets are from the list's kind, or from the file's start
        frames = []
        for name, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
            start = base + at
            if data[start : start + 4] != name or int.from_bytes(data[start + 4 : start + 8], "little") != size or start + 8 + size > len(data):
                frames = None
                break
            if name[2:] in (b"dc", b"db"):
                frames.append(data[start + 8 : start + 8 + size])
        if frames:
            return frames
    return []


def _walked(data: bytes, start: int, end: int) -> list[bytes]:
    """Frames of a movie list in the order of its chunks."""
    frames, at = [], start + 4
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST":
            at += 12
            continue
        if name[2:] in (b"dc", b"db") and at + 8 + size <= len(data):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return frames


# ---------------------------------------------------------------- payloads, shots, clips


def payload_of(text: bytes) -> bytes:
    """The text, with zero bytes up to a positive multiple of UNIT."""
    return text + b"\0" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload as an AVI of its own, one sample per byte."""
    counts = [-(-len(p) // FRAME) for p in payloads]
    samples = np.frombuffer(b"".join(p + b"\0" * (n * FRAME - len(p)) for p, n in zip(payloads, counts, strict=True)), np.uint8).reshape(-1, FRAME)
    frames, out, at = encode_frames(samples), [], 0
    for p, n in zip(payloads, counts, strict=True):
        out.append(write_avi(frames[at : at + n], COLUMNS * 8, ROWS * 8, note=f"payload_bytes={len(p)}"))
        at += n
    return out


def read_samples(movies: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Properties and (frames, samples) block means of each movie, all frames decoded together where they are fixed-width."""
    parsed = [parse_avi(m) for m in movies]
    fixed = [all(f.startswith(HEAD) for f in frames) for _, frames in parsed]
    together = [f for (_, frames), ok in zip(parsed, fixed, strict=True) if ok for f in frames]
    decoded, out, at = decode_fixed(together) if together else np.zeros((0, FRAME), np.uint8), [], 0
    for (found, frames), ok in zip(parsed, fixed, strict=True):
        if ok:
            out.append((found, decoded[at : at + len(frames)]))
            at += len(frames)
        else:
            out.append((found, np.stack([block_means(decode_jpeg(f)) for f in frames]) if frames else np.zeros((0, 0), np.uint8)))
    return out


def block_means(pixels: np.ndarray) -> np.ndarray:
    """Means of the 8x8 blocks of a picture, in rows."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(-1)
    grey = np.pad(grey, [(0, -grey.shape[0] % 8), (0, -grey.shape[1] % 8)], "edge")
    return np.rint(grey.reshape(grey.shape[0] // 8, 8, -1, 8).mean((1, 3))).astype(np.uint8).ravel()


def stored_payload(found: dict, samples: np.ndarray) -> bytes:
    noted = re.search(r"payload_bytes=(\d+)", found["note"])
    data = samples.tobytes()
    return data[: int(noted[1])] if noted else data


def cuts(samples: np.ndarray) -> list[int]:
    """Frames that begin a shot, the first frame left out."""
    if len(samples) < 2:
        return []
    bins = (samples >> 4).astype(np.int64) + BINS * np.arange(len(samples))[:, None]
    share = np.bincount(bins.ravel(), minlength=BINS * len(samples)).reshape(-1, BINS) / samples.shape[1]
    change = np.abs(np.diff(share, axis=0)).sum(1) / 2
    out = []
    for i, x in enumerate(change):
        before = change[max(0, i - WINDOW) : i]
        limit = before.mean() + SPREAD * before.std() if len(before) else 0.0
        if x > max(FLOOR, limit):
            out.append(i + 1)
    return out


def clips(found: dict, samples: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start and end in seconds) of each shot."""
    edges = [0, *cuts(samples), len(samples)] if len(samples) else []
    return [(i, a, b - a, a / found["fps"], b / found["fps"]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["media_id", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"]
    for batch in batches:
        rows = []
        for key, movie in zip(batch.column("media_id").to_pylist(), batch.column("media"), strict=True):
            try:
                rows += [(key, *c, None) for c in clips(*read_samples([movie.as_py() or b""])[0])]
            except Exception as why:  # noqa: BLE001  whatever a file raises belongs to its row
                rows.append((key, None, None, None, None, None, f"{type(why).__name__}: {why}"[:200]))
        types = [batch.column("media_id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def clip_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each detected shot of the AVI column; a file that cannot be read gives one row with `error`."""
    kind = media.schema[key].dataType.simpleString()
    return media.selectExpr(f"`{key}` AS media_id", f"`{column}` AS media").mapInArrow(_clip_rows, f"media_id {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, error string")


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tokens.text_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode_payloads([payload_of(x) for x in texts]), pa.binary())], ["doc_id", "media"])


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, media: each text as an AVI file."""
    tokens.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode_rows, "doc_id bigint, media binary")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_clips"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    for batch, texts in tokens.text_batches(batches):
        movies = encode_payloads([payload_of(x) for x in texts])
        rows = []
        for key, text, movie, (found, samples) in zip(batch.column("doc_id").to_pylist(), texts, movies, read_samples(movies), strict=True):
            payload, shots = stored_payload(found, samples), clips(found, samples)
            feature = f"frames={len(samples)};mean={samples.mean():.3f};clips=" + ",".join(f"{a:.2f}-{b:.2f}" for *_, a, b in shots)
            rows.append((key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(movie), hashlib.sha256(movie).hexdigest(), feature, len(samples), len(shots)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op2_avi_mjpeg(docs: DataFrame) -> DataFrame:
    """Stores every text as an AVI, reads the file's bytes back and returns digests, features and numbers of clips."""
    tokens.bound_batches(docs.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames int, n_clips int"
    return docs.select("doc_id", "text").mapInArrow(_digest_rows, schema)
