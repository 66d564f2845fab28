"""Language model, classifiers and similarity join."""

import math
import os
import random
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from textloom.llm import labelled, ngram_join, pitman_yor, quality_rank, tokens, toxic_neighbours
from textloom.tables import table


def test_word_hashes():
    texts = [b"A b  a", b"", b" \n", "é É".encode(), b"x" * 100]
    hashes, counts, spans = tokens.words(texts)
    assert counts.tolist() == [3, 0, 0, 2, 1]
    assert hashes[0] == hashes[2] != hashes[1] and hashes[3] != hashes[4]
    assert (b"\n".join(texts))[spans[4][0] : spans[4][1]].decode() == "É"
    folded, _, _ = tokens.words(texts, tokens.NOT_ALNUM, tokens.fold_latin)
    assert folded[3] == folded[4]
    keys, sizes = tokens.shingles(hashes, counts, 3)
    assert sizes.tolist() == [1, 0, 0, 1, 1] and len(set(keys.tolist())) == 3


def near_copies(seed):
    """Families of near copies at many similarities, exact copies, shared passages and short texts."""
    r = random.Random(seed)
    make = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    passage, texts = make(60), []
    for _ in range(12):
        base = make(r.choice([4, 30, 100, 250])) + (passage if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(texts[-1].upper())
    return list(enumerate([*texts, "", " ", "a", "A", "a b", "a b", *[" ".join(passage)] * 3]))


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    docs = near_copies(seed)
    sets = plain.shingle_sets(docs)
    expected = plain.components(sets)
    rows = ngram_join.op9_ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), expected[i]) for i, _ in docs}


def test_lower_threshold(spark):
    docs = near_copies(7)
    expected = plain.components(plain.shingle_sets(docs), 60)
    rows = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 60).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_join_on_documents(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    expected = plain.components(plain.shingle_sets(docs))
    rows = ngram_join.op9_ngram_jaccard_join(table(spark, sf, "documents")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert sum(i != c for i, c in expected.items()) > 5


def test_base_score(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    seq = {i: [*plain.words(plain.lower(t)), None] for i, t in docs.items()}
    counts = Counter(w for i, s in seq.items() if plain.remainder(i, 10) for w in s)
    n, v = sum(counts.values()), len(counts)
    rows = pitman_yor.score_texts(table(spark, sf, "documents").select("doc_id", (labelled.remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text"), contexts=300, shard_tokens=9000).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = seq[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(counts[w] > 0 for w in s), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    """Scores of one-word continuations, over the vocabulary and the unseen word, against the same context."""
    r = random.Random(3)
    train = [(10 * k + 1, " ".join(r.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=40))) for k in range(6)]
    words = ["a", "b", "c", "d"]
    tests = [(1000 + i, f"{w}") for i, w in enumerate([*words, "unseen", ""])]
    held = {i for i, _ in tests}
    docs = spark.createDataFrame([(i, i in held, t) for i, t in train + tests], "doc_id long, held_out boolean, text string")
    score = {row["doc_id"]: row["score"] for row in pitman_yor.score_texts(docs).collect()}
    # P(w | start) * P(end | w) for each word; the empty text is P(end | start).
    empty = 10 ** score[1005]
    assert 0 < empty < 1
    assert sum(10 ** score[1000 + i] for i in range(5)) + empty < 1


def test_seating_matches_the_process():
    """Tables of one dish drawn by blocks against customer-by-customer Gibbs sampling."""
    discount, strength, others, base, customers = 0.6, 1.0, 20, 0.02, 30
    rng = np.random.default_rng(5)
    n = 4000
    block = pitman_yor.draw_tables(np.full(n, customers), np.full(n, others), np.full(n, base), discount, strength, pitman_yor.stirling(discount), rng)
    sizes, seen = [1] * customers, []
    for sweep in range(3000):
        for _ in range(customers):
            k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
            sizes[k] -= 1
            if not sizes[k]:
                sizes.pop(k)
            weights = [s - discount for s in sizes] + [(strength + discount * (others + len(sizes))) * base]
            k = rng.choice(len(weights), p=np.array(weights) / sum(weights))
            if k == len(sizes):
                sizes.append(1)
            else:
                sizes[k] += 1
        seen.append(len(sizes))
    assert abs(block.mean() - np.mean(seen[200:])) < 0.25
    # With ever more customers, tables but the first follow a negative binomial distribution.
    many = pitman_yor.draw_tables(np.full(4000, 100_000), np.full(4000, 50), np.full(4000, 0.01), 0.5, 1.0, pitman_yor.stirling(0.5), rng)
    assert (many >= 1).all() and many.mean() == pytest.approx(1 + 0.01 / 0.99 * (1 / 0.5 + 50 + 1), abs=0.05)


def hpy(train, tests, discount, discount0, strength, sweeps, rng):
    """log10 probabilities of texts by Gibbs sampling of one customer at a time, averaged over sweeps."""
    seqs = [[*t.split(), None] for t in train]
    vocabulary = len({w for s in seqs for w in s})
    places: dict = {}  # (context, word) -> sizes of its tables
    base: dict = {}  # word -> sizes of its tables in the parent

    def sit(tables, p):
        weights = [n - d for n in tables] + [p]
        k = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def parent(w):
        all_n, all_t, own = sum(map(sum, base.values())), sum(map(len, base.values())), base.get(w, [])
        return (sum(own) - discount0 * len(own) + (strength + discount0 * all_t) / (vocabulary + 1)) / (strength + all_n)

    def restaurant(u):
        return [x for (a, _), x in places.items() if a == u]

    customers = [(s[k - 1] if k else "<s>", s[k]) for s in seqs for k in range(len(s))]
    totals = {}
    for sweep in range(sweeps):
        for u, w in customers:
            own = places.setdefault((u, w), [])
            if sweep and leave(own) and leave(base[w]) and not base[w]:
                del base[w]
            d = discount
            if sit(own, (strength + discount * sum(map(len, restaurant(u)))) * parent(w)):
                d = discount0
                sit(base.setdefault(w, []), (strength + discount0 * sum(map(len, base.values()))) / (vocabulary + 1))
        if sweep >= sweeps // 4:
            for i, t in tests:
                seq = ["<s>", *t.split(), None]
                for k in range(1, len(seq)):
                    u, w = seq[k - 1], seq[k]
                    all_n, all_t, own = sum(map(sum, restaurant(u))), sum(map(len, restaurant(u))), places.get((u, w), [])
                    p = (sum(own) - discount * len(own) + (strength + discount * all_t) * parent(w)) / (strength + all_n)
                    totals.setdefault((i, k), []).append(p)
    return {i: sum(math.log10(np.mean(totals[i, k])) for k in range(1, len(t.split()) + 2)) for i, t in tests}


def test_scores_match_customer_by_customer_sampling(spark):
    r = random.Random(8)
    train = [(10 * k + 1, " ".join(r.choices("abcdefgh", [9, 6, 4, 3, 2, 1, 1, 1], k=r.randint(3, 12)))) for k in range(14)]
    tests = [(1000, "a b a"), (1001, "h h c"), (1002, "zz a"), (1003, "")]
    docs = spark.createDataFrame([(i, i >= 1000, t) for i, t in train + tests], "doc_id long, held_out boolean, text string")
    ours = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(docs, burn_in=4, samples=12).collect()}
    seqs = [["<s>", *t.split(), None] for _, t in train]
    pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
    first = Counter(w for _, w in pairs)
    ney = lambda n: min(max(sum(v == 1 for v in n.values()) / max(sum(v == 1 for v in n.values()) + 2 * sum(v == 2 for v in n.values()), 1), 0.1), 0.95) if any(v == 1 for v in n.values()) else 0.5
    # Customers of the parent to begin with: one table for each pair.
    theirs = hpy([t for _, t in train], tests, ney(pairs), ney(first), pitman_yor.STRENGTH, 60, np.random.default_rng(0))
    for i, t in tests:
        assert ours[i] == pytest.approx(theirs[i], abs=0.06 * (len(t.split()) + 1)), (i, ours[i], theirs[i])


def test_contexts_without_a_code_by_formula(spark):
    """Words met once have no code, and each sits at one table for good: the restaurant of each is known."""
    docs = spark.createDataFrame([(1, False, "a b c d e f"), (2, True, "a c"), (3, True, "a b"), (4, True, "z c"), (5, True, "c a")], "doc_id long, held_out boolean, text string")
    score = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(docs, shard_tokens=3).collect()}
    d, n = 0.95, 7  # discounts where no pair occurs twice; six words and an end
    parent = (1 - d) / (1 + n) + (1 + d * n) / (n + 1) / (1 + n)
    met, unmet = (1 - d + (1 + d) * parent) / 2, (1 + d) * parent / 2
    unseen = (1 + d * n) / (n + 1) / (1 + n)
    expected = {2: [met, unmet, unmet], 3: [met, met, unmet], 4: [(1 + d) * unseen / 2, parent, unmet], 5: [unmet, unmet, unmet]}
    for i, p in expected.items():
        assert score[i] == pytest.approx(sum(map(math.log10, p)), abs=1e-6), i


@pytest.mark.parametrize(("contexts", "shard_tokens"), [(0, 20), (3, 20), (3, 1000)])
def test_contexts_without_a_code_match_customer_by_customer_sampling(spark, contexts, shard_tokens):
    """Pairs of coded and other words, in one shard and in many, against restaurants of their own for all contexts."""
    r = random.Random(12)
    after = {w: r.sample("abcdefgh", 8) for w in "abcdefgh"}
    train = []
    for k in range(16):
        text = [r.choice("abcdefgh")]
        while len(text) < 9:
            text.append(r.choices(after[text[-1]], [40, 9, 3, 1, 1, 1, 1, 1])[0])
        train.append((10 * k + 1, " ".join(text)))
    tests = [(1000 + k, f"{w} {after[w][0]} {after[after[w][0]][0]}") for k, w in enumerate("abcdefgh")] + [(1100, "zz a zz"), (1101, "h g")]
    docs = spark.createDataFrame([(i, i >= 1000, t) for i, t in train + tests], "doc_id long, held_out boolean, text string")
    ours = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(docs, burn_in=4, samples=12, contexts=contexts, shard_tokens=shard_tokens).collect()}
    seqs = [["<s>", *t.split(), None] for _, t in train]
    pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
    first = Counter(w for _, w in pairs)
    ney = lambda n: min(max(sum(v == 1 for v in n.values()) / (sum(v == 1 for v in n.values()) + 2 * sum(v == 2 for v in n.values())), 0.1), 0.95) if any(v == 1 for v in n.values()) else 0.5
    theirs = hpy([t for _, t in train], tests, ney(pairs), ney(first), pitman_yor.STRENGTH, 60, np.random.default_rng(0))
    for i, t in tests:
        assert ours[i] == pytest.approx(theirs[i], abs=0.04 * (len(t.split()) + 1)), (i, ours[i], theirs[i])


def test_held_out_rows_move_nothing(spark):
    r = random.Random(4)
    rows = [(i, False, " ".join(r.choices(["a", "b", "c", "rare", "x1", "x2"], k=12))) for i in range(20)]
    schema = "doc_id long, held_out boolean, text string"
    alone = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(spark.createDataFrame(rows, schema), contexts=3, shard_tokens=50).collect()}
    more = [*rows, *[(100 + k, True, "rare rare new new x1 x1 x1 " * 10) for k in range(3)]]
    both = {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(spark.createDataFrame(more, schema), contexts=3, shard_tokens=50).collect()}
    assert {i: both[i] for i in alone} == alone


def test_predictive_probabilities_sum_to_one():
    """Over the vocabulary and the one unseen word, in the parent and in a context."""
    rng = np.random.default_rng(2)
    customers = rng.integers(1, 9, 50)
    tables0 = np.minimum(customers, rng.integers(1, 4, 50))
    c = rng.integers(0, 5, 50)
    t = np.minimum(c, rng.integers(1, 3, 50))
    g = pitman_yor.Globals(0.7, 0.6, 1.0, 50, np.array([t.sum()]), customers, tables0, int(tables0.sum()), int(customers.sum()))
    parent = np.append(g.parent(customers, tables0), g.spread())
    assert parent.sum() == pytest.approx(1, abs=1e-9)
    p = pitman_yor._pair_probability(np.append(c, 0), np.append(t, 0), t.sum(), c.sum(), parent, g)
    assert p.sum() == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize(("discount", "others", "base", "customers"), [(0.7, 400, 0.03, 1500), (0.7, 20, 0.02, 300), (0.5, 50, 0.01, 1500), (0.8, 5000, 0.0005, 200), (0.7, 400, 0.03, 150), (0.7, 9000, 0.03, 1500), (0.3, 3000, 0.02, 900), (0.9, 2000, 0.2, 1200)])
def test_seating_of_many_customers(discount, others, base, customers):
    """Against the whole posterior from tabled Stirling numbers."""
    j = np.arange(customers)
    log = np.cumsum(np.log(1 + discount * (others + j))) + np.log(base) * (j + 1) + pitman_yor.stirling(discount, customers)[customers, 1:]
    p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    mean = (p * (j + 1)).sum()
    sd = math.sqrt((p * (j + 1 - mean) ** 2).sum())
    ours = pitman_yor.draw_tables(np.full(6000, customers), np.full(6000, others), np.full(6000, base), discount, 1.0, pitman_yor.stirling(discount), np.random.default_rng(6))
    assert ours.mean() == pytest.approx(mean, rel=0.02, abs=0.1) and ours.std() == pytest.approx(sd, rel=0.05, abs=0.05)


def test_sample_is_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 1000, 7, 3).collect()
    assert len(rows) == 3 and all(r["text"] == min(f"text {i}" for i in range(200) if i % 5 == r["doc_id"]) for r in rows)


def test_ranking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_rank.FEATURES)))
    y = (x[:, 0] - x[:, 2] > -1).astype(int)
    model = quality_rank.fit(x, y)
    assert ((model.score(x) >= quality_rank.CUT) == y).mean() > 0.95
    assert np.allclose(quality_rank.fit(x[:0], y[:0]).score(x), 0.5)


def test_ranking_minimises_the_loss_and_cuts_at_the_quantile():
    """Against the penalised loss as it is written, and the quantile by sorting."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + 0.8 * rng.normal(size=300) > -0.4).astype(int)
    model = quality_rank.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    draw = np.random.default_rng(7)
    better, worse = draw.choice(np.flatnonzero(y == 1), quality_rank.PAIRS), draw.choice(np.flatnonzero(y == 0), quality_rank.PAIRS)
    loss = lambda w: np.log1p(np.exp(-(z[better] - z[worse]) @ w)).mean() + quality_rank.PENALTY / 2 * w @ w
    least = loss(model.weights)
    for k in range(6):
        for step in (-0.01, 0.01):
            assert loss(model.weights + step * np.eye(6)[k]) > least
    ranked = sorted(float(v) for v in z @ model.weights)
    n = int((y == 0).sum())
    assert model.threshold == pytest.approx((ranked[n - 1] + ranked[n]) / 2)
    assert ((model.score(x) >= quality_rank.CUT).sum()) == 300 - n


def test_trigram_shares():
    texts = [b"abcabc", b"ab", b"", b"ABC 1234", "é".encode() * 4]
    shares = quality_rank.trigrams(texts)
    assert np.allclose(shares.sum(1), [1, 0, 0, 1, 1])
    assert np.allclose(shares, np.vstack([quality_rank.trigrams([t]) for t in texts]))
    assert np.allclose(quality_rank.trigrams([b"xy 123 z"]), quality_rank.trigrams([b"XY 777 Z"]))


def test_scores_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text of words " * 9, 0.5, 7)], "doc_id long, text string, score double, other int")
    model = quality_rank.fit(np.zeros((0, len(quality_rank.FEATURES))), np.zeros(0))
    row = quality_rank.score(docs, model, "quality").head()
    assert (row["score"], row["other"]) == (0.5, 7) and 0 <= row["quality"] <= 1
    assert quality_rank.score(docs, model).columns == ["doc_id", "text", "other", "score"]


def _random_examples(seed, n=400, terms=60):
    rng = np.random.default_rng(seed)
    vocabulary = np.sort(rng.integers(0, 1 << 60, terms).astype(np.uint64))
    chance = 1 / np.arange(1, terms + 1)
    docs = [np.sort(rng.choice(terms, rng.integers(0, 12), replace=False, p=chance / chance.sum())) for _ in range(n)]
    tf = [rng.integers(1, 4, len(d)) for d in docs]
    labels = np.array([int((d > 40).any()) if rng.random() < 0.9 else 1 for d in docs])
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return vocabulary, docs, tf, labels, toxic_neighbours.examples(np.arange(n), labels, vocabulary[flat(docs)], flat(tf), np.array(list(map(len, docs))))


@pytest.mark.parametrize(("frequent", "step", "open_"), [(400, 64, 128), (5, 2, 12), (1, 1, 0), (20, 3, 30)])
def test_scores_against_dense_cosines(monkeypatch, frequent, step, open_):
    """Neighbours, votes and calibrated scores of the index against all cosines, worked out from counts."""
    for name, x in (("FREQUENT", frequent), ("STEP", step), ("OPEN", open_)):
        monkeypatch.setattr(toxic_neighbours, name, x)
    vocabulary, docs, tf, labels, e = _random_examples(2)
    index = toxic_neighbours.build(e)
    kept, share = {int(i): k for k, i in enumerate(e.ids)}, dict(zip(e.ids.tolist(), e.labels.tolist(), strict=True))

    def dense(ids, queries):
        """Cosines of queries with the examples of these ids, and the examples' labels."""
        y = np.array([share[i] for i in ids])
        counts = np.zeros((len(ids), len(vocabulary)))
        for k, i in enumerate(ids):
            counts[k, docs[i]] = tf[i]
        n, n1, has = len(ids), y.sum(), counts > 0
        a, df = (has * y[:, None]).sum(0), has.sum(0)
        s = toxic_neighbours.SHRINK
        tie = 0.01 + np.abs(np.log((a + s * n1 / n) / (n1 + s) / ((df - a + s * (n - n1) / n) / (n - n1 + s))))
        weight = np.where(df > 0, np.log(1 + n / np.maximum(df, 1)) * tie, 0)
        unit = lambda c: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))(np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * weight)
        q = np.zeros((len(queries), len(vocabulary)))
        for k, i in enumerate(queries):
            q[k, docs[i]] = tf[i]
        return unit(q) @ unit(counts).T, y

    def vote(sims, y, ids):
        order = [k for k in sorted(range(len(ids)), key=lambda k: (-round(float(sims[k]), 6), ids[k])) if sims[k] > 1e-9][: toxic_neighbours.K]
        if not order:
            return None, []
        weight = 1 / (1.05 - np.minimum(sims[order], 1))
        return ((weight * y[order]).sum() + y.mean()) / (weight.sum() + 1), [ids[k] for k in order]

    ids = sorted(kept)
    fold = {i: int(f) for i, f in zip(ids, tokens.mix(np.array(ids, np.uint64)) % np.uint64(toxic_neighbours.FOLDS), strict=True)}
    xs, ys = [], []
    for f in range(toxic_neighbours.FOLDS):
        others, own = [i for i in ids if fold[i] != f], [i for i in ids if fold[i] == f]
        sims, y = dense(others, own)
        for i, s in zip(own, sims, strict=True):
            v, _ = vote(s, y, others)
            if v is not None:
                xs.append(v)
                ys.append(share[i])
    places, shares = toxic_neighbours.isotonic(np.array(xs), np.array(ys))
    sims, y = dense(ids, range(len(docs)))
    for i, s in enumerate(sims):
        at, w = index.vector(vocabulary[docs[i]], tf[i].astype(float))
        score, rows, found = index.score(at, w)
        v, names = vote(s, y, ids)
        assert sorted(np.round(found, 5)) == pytest.approx(sorted(np.round([s[ids.index(n)] for n in names], 5)), abs=2e-5)
        expected = index.prior if v is None else np.interp(v, places, shares)
        assert score == pytest.approx(expected, abs=1e-3), (i, score, expected)
        assert (v is None) == (not len(rows))


def test_copies_are_one_example():
    rng = np.random.default_rng(1)
    base, other = np.sort(rng.choice(10_000, 100, replace=False)), np.sort(rng.choice(10_000, 100, replace=False))
    near = np.sort(np.append(base[:-4], [20_000, 20_001, 20_002, 20_003]))
    docs = [base, other, base, near, np.zeros(0, np.int64), np.zeros(0, np.int64)]
    flat = np.concatenate(docs)
    e = toxic_neighbours.examples(np.arange(10, 16), np.array([1, 0, 0, 1, 0, 1]), flat.astype(np.uint64), np.ones(len(flat), np.int64), np.array(list(map(len, docs))))
    assert e.ids.tolist() == [10, 11, 14, 15] and e.labels.tolist() == pytest.approx([2 / 3, 0, 0, 1])


def test_terms_are_words_and_stems():
    hashes, tf, counts = toxic_neighbours.terms([b"Stupidly stupid STUPIDLY a", b"", "é É".encode()])
    assert counts.tolist() == [4, 0, 1] and sorted(tf[:4].tolist()) == [1, 1, 2, 2] and tf[4] == 2
    assert set(hashes[:4]) >= set(tokens.words([b"stupidly stupid a"])[0])


@pytest.mark.parametrize(("name", "operator", "recall", "precision"), [("quality", quality_rank.op8_bradley_terry_quality, 0.98, 0.98), ("toxic", toxic_neighbours.op10_toxic_neighbours, 0.9, 0.95)])
def test_held_out(spark, name, operator, recall, precision):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    labels = table(spark, folder, "labels")
    rows = operator(table(spark, folder, "documents"), labels).filter("held_out").join(labels, "doc_id").select("predicted", name).collect()
    hit = sum(r[0] == r[1] == 1 for r in rows)
    assert hit >= recall * sum(r[1] for r in rows) and hit >= precision * sum(r[0] for r in rows)
