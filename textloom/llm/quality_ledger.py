"""Rule bitmask ledger: every quality rule is evaluated once and stored as one bit beside the measurements it used.

Policies are versioned sets of rules and only read the stored bits; ablations are bitwise aggregates over them.
Everything is a projection of the scanned row (no shuffle, no Python): a document's measurements need only its own text.

Defined results: a null or empty text has no words and fails `too_few_words`; ties and repeated rows are measured
alike, row by row; an empty table gives an empty ledger; further columns pass through, and those named like a ledger
column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these.
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASUREMENTS = (*BASE_COLUMNS, "n_lines", "n_letters", "n_upper", "n_same_next")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda variable is never inlined into nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(hashes: Column, n: Column, window: int = WINDOW) -> Column:
    """Number of positions covered by windows of word hashes that occur twice or more, the first included."""

    def of_windows(keys: Column) -> Column:
        keyed = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda k, e: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(s, lambda e, k: same(k - 1, e) | same(k + 1, e)), lambda e: e["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(keyed, covered))

    keys = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
    return F.when(n > window, let(keys, of_windows)).otherwise(F.lit(0))


def measurements(text: Column) -> dict[str, Column]:
    """Measurement name -> long column of a text. words and lines are bound once each."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        of_hashes = lambda h: F.struct(
            repeated_window_words(h, n).alias("n_repeat_words"),
            F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, F.when(i > 0, i - 1).otherwise(0)) == x))).alias("n_same_next"),
        )
        return F.struct(n.alias("n_words"), let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("of"))

    kept = let(words, of_words)
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return {
        "words": kept,
        "lines": of_lines,
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(SPACE)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
    }


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds; bit is its place in the mask, for good."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: stored ledgers of earlier versions stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "shouting", "2 * n_upper > n_letters"),
    Rule(5, "stuttering", "10 * n_same_next > 3 * n_words"),
    Rule(6, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(7, "no_letters", "10 * n_letters < 3 * word_chars"),
)
BASE_RULES = ("too_few_words", "repeated_windows")
#: Version -> names of the rules that reject.
POLICIES = {"v1": BASE_RULES, "v2": tuple(r.name for r in RULES)}
PRODUCTION = "v2"


def rule_mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum({1 << bits[n] for n in names})


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with all measurements and `fail_mask`, bit r.bit set where rule r fails."""
    own = measurements(F.col(text))
    clashing = [c for c in docs.columns if c in {*MEASUREMENTS, "fail_mask", "_words", "_lines"}]
    wide = docs.drop(*[c for c in clashing if c != text])
    out = wide.withColumns({"_words": own["words"], "_lines": own["lines"], **{k: own[k].cast("long") for k in ("word_chars", "n_symbols", "n_letters", "n_upper")}})
    out = out.withColumns({
        "n_words": F.col("_words.n_words").cast("long"),
        "n_repeat_words": F.col("_words.of.n_repeat_words").cast("long"),
        "n_same_next": F.col("_words.of.n_same_next").cast("long"),
        "n_lines": F.col("_lines.n_lines").cast("long"),
        "n_dup_lines": F.col("_lines.n_dup_lines").cast("long"),
    }).drop("_words", "_lines")
    mask = F.lit(0).cast("long")
    for r in rules:
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_mask", mask)


def apply_policy(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """entries with `base_failed` and `kept`, from the stored bits only."""
    hit = lambda names: F.col("fail_mask").bitwiseAND(F.lit(rule_mask(names)).cast("long")) != 0
    return entries.withColumn("base_failed", hit(BASE_RULES)).withColumn("kept", ~hit((*BASE_RULES, *POLICIES[policy])))


def ablations(entries: DataFrame, policy: str = PRODUCTION, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each rule of the policy: how many documents it fails, fails alone, and how many the policy would keep without it."""
    whole = rule_mask(POLICIES[policy], rules)
    masked = F.col("fail_mask").bitwiseAND(F.lit(whole).cast("long"))
    rows = []
    for r in (r for r in rules if whole >> r.bit & 1):
        bit = F.lit(1 << r.bit).cast("long")
        rows.append(F.struct(F.lit(r.name).alias("rule"), F.count_if(masked.bitwiseAND(bit) != 0).alias("n_failed"), F.count_if(masked == bit).alias("n_only_this"), F.count_if(masked.bitwiseAND(F.lit(whole & ~(1 << r.bit)).cast("long")) == 0).alias("n_kept_without")))
    return entries.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def op3_quality_ledger(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Contract columns, then the ledger's other measurements and its mask."""
    out = apply_policy(ledger(docs.select("doc_id", "text")), policy)
    return out.select("doc_id", *BASE_COLUMNS, "base_failed", "kept", "n_lines", "n_letters", "n_upper", "n_same_next", "fail_mask")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER d AS w1, lead(word, 2) OVER d AS w2, lead(word, 3) OVER d AS w3, lead(word, 4) OVER d AS w4,
             lead(word, 5) OVER d AS w5, lead(word, 6) OVER d AS w6, lead(word, 7) OVER d AS w7, lag(word) OVER d AS before
      FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4, w5, w6, w7) AS n FROM g WHERE w7 IS NOT NULL),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM k, (SELECT unnest(range(8)) AS o) WHERE n > 1 GROUP BY doc_id),
same AS (SELECT doc_id, count(*) FILTER (word = before) AS n_same_next FROM g GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS n_upper,
             CAST(coalesce(n_same_next, 0) AS BIGINT) AS n_same_next
      FROM t JOIN w USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN same USING (doc_id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
             + 16 * (2 * n_upper > n_letters)::INT + 32 * (10 * n_same_next > 3 * n_words)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
             + 128 * (10 * n_letters < 3 * word_chars)::INT AS BIGINT) AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept, n_lines, n_letters, n_upper, n_same_next, fail_mask FROM f
"""
