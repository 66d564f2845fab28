"""The pipeline's stages, each against plain Python on its own input."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import plain
import pytest

from textloom.llm import piece_lattice, quality_ledger, quality_rank, registry
from textloom.tables import table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, sf)
        out.append((docs, spark.createDataFrame(after.collect(), after.schema)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in pipeline.STAGES], out, strict=True))


def _ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_deduplication", "source_mixing", "sentencepiece_encoding"]


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert tuple(after.columns) == pipeline.COLUMNS, name


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    kept = _ids(after)
    base = [r["doc_id"] for r in before.collect() if len(plain.words(r["text"])) >= 20 and 100 * plain.rules(r["text"])[4] <= 30 * len(plain.words(r["text"]))]
    assert set(kept) <= set(base) and len(kept) > 0.5 * len(base)
    assert kept == _ids(quality_ledger.apply_policy(quality_ledger.ledger(before)).filter("kept"))


def test_quality_classifier(spark, sf, stages):
    """Kept are the documents over the cut of a model that plain numpy scores from its weights."""
    before, after = stages["quality_classifier"]
    model = quality_rank.train(before, table(spark, sf, "labels"))
    rows = before.collect()
    x = np.vstack([quality_rank.features([(r["text"] or "").encode()]) for r in rows])
    raw = np.clip((x - model.mean) / model.scale, -6, 6) @ model.weights - model.threshold
    odds = [0.3 / 0.7 * math.exp(min(max(z, -60), 60)) for z in raw]
    assert _ids(after) == sorted(r["doc_id"] for r, o in zip(rows, odds, strict=True) if o / (1 + o) >= 0.3 - 1e-12)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    held = [(r["doc_id"], labels[r["doc_id"]]) for r in rows if labels.get(r["doc_id"]) is not None and plain.remainder(r["doc_id"], 5) == 0]
    assert sum((i in set(_ids(after))) == bool(q) for i, q in held) >= 0.9 * len(held)


def test_deduplication(stages):
    before, after = stages["ngram_deduplication"]
    found = plain.components(plain.shingle_sets([(r["doc_id"], r["text"]) for r in before.collect()], 5), 80)
    assert _ids(after) == sorted(set(found.values()))


def test_deduplication_takes_five_words_and_four_fifths(spark, sf):
    """One word in 50 changed, or a sixth added: under 90% on three words, over 80% on five."""
    base = [f"w{i}" for i in range(200)]
    texts = {1: base, 2: [f"z{i}" if i % 50 == 25 else w for i, w in enumerate(base)], 3: [f"y{i}" for i in range(200)]}
    texts[4] = texts[3] + [f"x{i}" for i in range(33)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 9) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    sets = {w: plain.shingle_sets([(i, " ".join(t)) for i, t in texts.items()], w) for w in (3, 5)}
    assert set(plain.components(sets[3], 90).values()) == {1, 2, 3, 4} and set(plain.components(sets[5], 80).values()) == {1, 3}
    assert _ids(pipeline.ngram_deduplication(spark, docs, sf)) == [1, 3]


def served(rows):
    """doc_id -> copies, by a queue of words for each source in plain Python."""
    queues = {}
    for r in rows:
        queues.setdefault(r["source"], []).append((hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], len(plain.words(r["text"]))))
    names = sorted((s for s in queues if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in queues)
    sizes = {s: sum(n for *_, n in queues[s]) for s in queues}
    words = sorted(((k + 1) * 6 // (i % 3 + 1), i, s) for i, s in enumerate(names) for k in range(3 * sizes[s]))[: sum(sizes.values())]
    got = Counter(s for *_, s in words)
    copies = {}
    for s, queue in queues.items():
        for epoch in range(3):
            at = epoch * sizes[s]
            for _, i, n in sorted(queue):
                part = min(max(got[s] - at, 0), n)
                copies[i] = copies.get(i, 0) + (n > 0 and 2 * part >= n)
                at += n
    return copies


def test_mixing(stages):
    before, after = stages["source_mixing"]
    copies = served(before.collect())
    assert _ids(after) == sorted(i for i, n in copies.items() for _ in range(n))
    sizes = {}
    for r in before.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(plain.words(r["text"]))
    longest = max(len(plain.words(r["text"])) for r in before.collect())
    taken = {}
    for r in after.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(plain.words(r["text"]))
    for s, t in plain.targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= longest


def best_segmentation(model, text):
    """Ids of the best path through all pieces of the marked text, over whole texts, ties to the longest last piece."""
    marked = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [float("-inf")] * len(marked), [None] * (len(marked) + 1)
    longest = max(map(len, model.pieces))
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - longest), j):
            known = model.pieces.get(marked[i:j])
            if known is None and (j - i > 1 or marked[i] in model.pieces):
                continue
            k, s = known or (-1, model.unknown)
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    path, j = [], len(marked)
    while j:
        i, k = back[j]
        path.append((i, j, k))
        j = i
    return list(model.ids_of(marked, path[::-1])) if text else []


def test_encoding(stages):
    before, after = stages["sentencepiece_encoding"]
    assert _ids(after) == _ids(before)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) and r["nbest_scores"][0] == r["best_score"] for r in after.collect())
    model, texts = piece_lattice.Model(registry.PIECES), {r["doc_id"]: r["text"] for r in before.collect()}
    short = [r for r in after.collect() if len(texts[r["doc_id"]]) < 2500][:25]
    assert len(short) > 10 and all(r["piece_ids"] == best_segmentation(model, texts[r["doc_id"]]) for r in short)


def test_run(spark, sf, stages):
    assert _ids(pipeline.run(spark, sf)) == _ids(stages["sentencepiece_encoding"][1])


def test_rows_without_id_and_repeated_rows(spark, sf):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (None, "x y z", "en", "s", 5), (None, "a b c d e", "en", "s", 9), (7, "p q r", "en", "s", 5), (7, "u v w", "en", "s", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.ngram_deduplication(spark, docs, sf).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(map(str, [(1, "a b c d e"), (None, "x y z"), (7, "p q r"), (7, "u v w"), (3, None)]))
    mixed = pipeline.source_mixing(spark, docs, sf).collect()
    assert len(mixed) == 7 and sum(r["doc_id"] is None for r in mixed) == 2  # one source, which is served once; no words, no service
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []
