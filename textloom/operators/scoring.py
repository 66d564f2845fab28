"""Scores of section texts and the choice among candidates.

Defined results: a null text is an empty one, and an empty one has the score NO_CONTENT; of equal scores the earliest
candidate wins; repeated rows are scored each; an empty table gives no rows. Tables keep the columns that are named, no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let, lines, pstrip, runs, words
from textloom.operators.linefilter import CYRILLIC, LATIN, is_tag_line, may_have_cyrillic

N = 4
#: Most n-grams, of 16 bytes each with their text's id, that are broadcast.
SHIPPED = 1_000_000
#: Score of a section without content, and of an empty list of candidates.
NO_CONTENT, NO_CANDIDATE = -1e9, -1e18


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), pstrip), lambda x: (x != "") & ~(x.startswith("<") & is_tag_line(x)))


def letter_counts(text: Column) -> Column:
    """struct<cyr, lat>: what is left of the text without other characters, which go run by run."""
    left = lambda letters: F.length(F.regexp_replace(text, f"[^{letters[1:-1]}]+", ""))
    return F.struct(F.when(~may_have_cyrillic(text), 0).otherwise(left(CYRILLIC)).alias("cyr"), left(LATIN).alias("lat"))


def ngrams(tokens: Column, n: int = N) -> Column:
    """n-grams of an array of words, joined by spaces; none where there are fewer words."""
    join = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    return let(tokens, lambda w: F.when(F.size(w) >= n, join(w)).otherwise(F.array().cast("array<string>")))


def ngram_hashes(tokens: Column, n: int = N) -> Column:
    """64-bit hashes of an array's n-grams: what counting and comparing them needs."""
    of = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    # A word is hashed once, not once for each n-gram that it is in.
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, of(h)).otherwise(F.array().cast("array<bigint>")))


def line_frequencies(content: Column) -> Column:
    """struct<max_repeat, top3, n_distinct>: most frequent line, sum of the three highest frequencies, distinct lines."""
    of = lambda c: F.struct(F.coalesce(F.get(c, F.lit(0)), F.lit(0)).alias("max_repeat"), F.aggregate(F.slice(c, 1, 3), F.lit(0), lambda a, x: a + x).alias("top3"), F.size(c).alias("n_distinct"))
    once = lambda n: F.struct(F.least(F.lit(1), n).alias("max_repeat"), F.least(F.lit(3), n).alias("top3"), n.alias("n_distinct"))

    def counted(found: Column) -> Column:
        # Lines of most texts differ: only the others are sorted.
        repeated = let(F.sort_array(runs(F.sort_array(found)), asc=False), of)
        return let(F.size(F.array_distinct(found)), lambda n: F.when(n == F.size(found), once(n)).otherwise(repeated))

    return let(content, counted)


def repetition(tokens: Column, n: int = N) -> Column:
    """Share of an array's n-grams that repeat an earlier one."""
    return let(ngram_hashes(tokens, n), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.greatest(F.lit(1), F.size(g)))


def _content(text: Column) -> Column:
    """struct<lines, grams, joined, n_words> of a text: everything that scores and comparisons read of it."""
    of = lambda content: let(
        F.array_join(content, " "), lambda joined: let(words(joined), lambda w: F.struct(content.alias("lines"), ngram_hashes(w).alias("grams"), joined.alias("joined"), F.size(w).alias("n_words")))
    )
    return let(content_lines(text), of)


def _statistics(c: Column) -> Column:
    def of(f: Column) -> Column:
        n, grams = F.greatest(F.lit(1), F.size(c["lines"])), c["grams"]
        letters = letter_counts(c["joined"])
        return F.struct(
            F.size(c["lines"]).alias("n_lines"), c["n_words"].alias("n_words"), (c["n_words"] / n).alias("avg_words"), (f["n_distinct"] / n).alias("uniq_ratio"),
            f["max_repeat"].alias("max_repeat"), f["top3"].alias("top3"), ((F.size(grams) - F.size(F.array_distinct(grams))) / F.greatest(F.lit(1), F.size(grams))).alias("repetition"),
            letters["cyr"].alias("cyr"), letters["lat"].alias("lat"),
        )

    return let(line_frequencies(c["lines"]), of)


def line_statistics(text: Column) -> Column:
    """struct<n_lines, n_words, avg_words, uniq_ratio, max_repeat, top3, repetition, cyr, lat> of a section's content."""
    return let(_content(text), _statistics)


def line_averages(text: Column) -> Column:
    """struct<n_lines, avg_words, uniq_ratio>: these of line_statistics, without n-grams and letters."""

    def of(content: Column) -> Column:
        n, n_words, n_distinct = F.greatest(F.lit(1), F.size(content)), F.size(words(F.array_join(content, " "))), F.size(F.array_distinct(content))
        return F.struct(F.size(content).alias("n_lines"), (n_words / n).alias("avg_words"), (n_distinct / n).alias("uniq_ratio"))

    return let(content_lines(text), of)


def score_section(text: Column) -> Column:
    """Fluency score of one section; NO_CONTENT where no content line is left."""
    return let(_content(text), _score)


def _score(content: Column) -> Column:
    def of(s: Column) -> Column:
        # Weights and limits of the score.
        value = (
            4.0 * s["cyr"] / F.greatest(F.lit(1), s["cyr"] + s["lat"]) + 0.10 * s["n_lines"] + 0.20 * s["avg_words"] + 2.0 * s["uniq_ratio"]
            - 4.0 * F.greatest(F.lit(0), s["max_repeat"] - 2) - 0.8 * F.greatest(F.lit(0), s["top3"] - 8) - 3.5 * s["repetition"]
            - F.when(s["uniq_ratio"] < 0.4, 5.0).otherwise(0.0) - 2.0 * F.greatest(F.lit(0.0), s["avg_words"] - 20) - F.when(s["lat"] > 0, 10.0).otherwise(0.0)
        )
        return F.when(s["n_lines"] == 0, F.lit(NO_CONTENT)).otherwise(value)

    return let(_statistics(content), of)


def containment(current: Column, previous: Column) -> Column:
    """Share of the current array's distinct elements that the previous array has; 0 where the current one is empty."""
    return let(F.array_distinct(current), lambda c: F.when(F.size(c) > 0, F.size(F.array_intersect(c, previous)) / F.size(c)).otherwise(0.0))


def line_overlap(text: Column, previous: Column) -> Column:
    return containment(content_lines(text), content_lines(previous))


def ngram_overlap(text: Column, previous: Column, n: int = N) -> Column:
    grams = lambda t: ngram_hashes(words(F.array_join(content_lines(t), " ")), n)
    return containment(grams(text), grams(previous))


def score_in_context(text: Column, previous: Column) -> Column:
    """score_section less penalties for lines and n-grams taken from the context; a blank context costs nothing."""

    context = lambda content: F.struct(content.alias("lines"), ngram_hashes(words(F.array_join(content, " "))).alias("grams"))

    def of(now: Column) -> Column:
        def against(then: Column) -> Column:
            penalty = 8.0 * containment(now["lines"], then["lines"]) + 6.0 * containment(now["grams"], then["grams"])
            return let(_score(now), lambda s: s - F.when(s == NO_CONTENT, 0.0).otherwise(penalty))

        # A blank context has no lines and no n-grams, so that nothing is contained in it.
        return let(let(content_lines(previous), context), against)

    return let(_content(text), of)


def ngram_matches(current: DataFrame, current_id: str, other: DataFrame, other_id: str, n: int = N) -> DataFrame:
    """Pairs of texts that share n-grams: current_id, other_id, n_shared, ratio to the current text's distinct n-grams.

    An equi-join on hashes of n-grams, distinct per text. Where the other side has at most SHIPPED of them, which is counted
    first, they are broadcast, and the current side's n-grams never leave their task but for those that match.
    """
    grams = lambda df, key: df.select(key, F.array_distinct(ngram_hashes(words(F.array_join(content_lines(F.col("text")), " ")), n)).alias("_g"))
    left = grams(current, current_id).select(current_id, F.size("_g").alias("_n"), F.explode("_g").alias("_gram"))
    right = grams(other, other_id)
    small = (right.agg(F.sum(F.size("_g"))).head()[0] or 0) <= SHIPPED
    right = right.select(other_id, F.explode("_g").alias("_gram"))
    right = F.broadcast(right) if small else right.hint("shuffle_hash")
    return left.join(right, "_gram").groupBy(current_id, other_id).agg(F.count("*").alias("n_shared"), (F.count("*") / F.max("_n")).alias("ratio"))


def best_candidate(candidates: DataFrame, group: str, order: str, score: str = "score", text: str = "text") -> DataFrame:
    """The highest score of each group, the earliest of equal ones; partial maxima are taken before the shuffle."""
    best = F.max_by(F.struct(order, text, score), F.struct(F.col(score), -F.col(order)))
    return candidates.groupBy(group).agg(best.alias("_b")).select(group, F.col(f"_b.{order}").alias(order), F.col(f"_b.{text}").alias(text), F.col(f"_b.{score}").alias(score))


def choose_best(candidates: Column, scores: Column) -> Column:
    """struct<text, score> of the best of two parallel arrays, the earliest of equal ones; ("", NO_CANDIDATE) of empty ones."""
    zipped = F.transform(F.arrays_zip(candidates.alias("c"), scores.alias("s")), lambda x, i: F.struct(x["s"].alias("score"), (-i).alias("place"), x["c"].alias("text")))
    best = F.array_max(zipped)
    return F.struct(F.coalesce(best["text"], F.lit("")).alias("text"), F.coalesce(best["score"], F.lit(NO_CANDIDATE)).alias("score"))
