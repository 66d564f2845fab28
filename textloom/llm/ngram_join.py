"""N-gram Jaccard self-join by rare-first prefix filtering, and the components of its links.

Documents with equal shingle sets are one class; classes are joined. A class's shingles are ordered rare first, and only
a prefix of them is emitted: two sets over the threshold share a shingle of their prefixes. The order comes from two
frequency sketches of fixed size over all documents: shingles that the first shows to be common (passages, phrases) come
last, all others in order of their words' frequencies in the second. Any common order keeps the filter exact. Length,
positional and suffix filters cut candidates before a pair is verified, once, on whole sets. The suffix filter of the
method bounds the difference of two sets' suffixes by recursive halving, which needs both sets in one place; here each set
carries the parities of its sizes in BINS hash ranges, whose differences bound the difference of the whole sets from below
without them, so that sets are fetched for pairs that pass alone.

Links within a group of n near copies are not all emitted: first every class is compared with one hub class of each of its
prefix buckets, then, across the components these links make, all pairs that share a bucket. No link between different
components is lost, so components are those of all links.

Shingles and classes are 64-bit hashes: n distinct sets are expected to collide in n**2 / 2**65 cases.

Defined results: null or wordless texts have no shingles and are linked with nothing; with fewer words than the width, the
whole sequence is one shingle; repeated rows and copies fall into one class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom, tokens
from textloom.llm.components import components
from textloom.tables import materialize, write_scratch

#: Words of a shingle and percent of similarity, where a caller names no others.
WIDTH, PERCENT = 5, 80
#: Cells of each of the two frequency sketches (16 bits each when sent to executors), and cells of one of their slices.
SKETCH_BITS, SLICE_BITS = 22, 16
#: Tasks whose slices are added up together before the last sum.
FAN_IN = 256
#: Hash ranges of the suffix filter.
BINS = 512
SIGNS = tuple(f"s{k}" for k in range(BINS // 64))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(spelled: tuple[np.ndarray, np.ndarray], n: int, width: int):
    """Of n texts' words: distinct shingles (flat, by text), numbers, class ids and parities of the sets' sizes in BINS hash ranges."""
    keys, sizes = tokens.shingles(*spelled, width)
    doc = np.repeat(np.arange(n), sizes)
    total, ends = np.zeros(len(keys) + 1, np.uint64), np.cumsum(sizes)
    np.cumsum(tokens.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    ids = tokens.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
    return keys, sizes, ids.view(np.int64), doc


def _parities(keys: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """Bit b of a text: whether its set has an odd number of shingles in hash range b of BINS; as BINS / 64 columns."""
    odd = np.bincount(doc * BINS + (keys & np.uint64(BINS - 1)).astype(np.int64), minlength=n * BINS).reshape(n, BINS) & 1
    packed = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return [np.ascontiguousarray(packed[:, k]) for k in range(BINS // 64)]


def _classes(width: int):
    names = ["part", "blob", "doc_id", "n_shingles", "class_id", *SIGNS]
    types = [pa.int32(), pa.binary(), *[pa.int64()] * (3 + len(SIGNS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 << SKETCH_BITS, np.uint32)  # of shingles, then of words
        for batch, texts in tokens.text_batches(batches):
            spelled = tokens.words(texts)[:2]
            keys, sizes, ids, doc = _sets(spelled, len(texts), width)
            np.add.at(sketch, _cell(keys), 1)
            np.add.at(sketch, _cell(spelled[0]) + (1 << SKETCH_BITS), 1)
            n, empty = len(texts), pa.nulls
            yield pa.RecordBatch.from_arrays([empty(n, pa.int32()), empty(n, pa.binary()), batch.column("doc_id"), pa.array(sizes), pa.array(ids), *map(pa.array, _parities(keys, doc, n))], names)
        parts = np.flatnonzero(sketch.reshape(-1, 1 << SLICE_BITS).any(1))
        group = TaskContext.get().partitionId() // FAN_IN << (SKETCH_BITS + 1 - SLICE_BITS)
        blobs = [_squeeze(sketch[p << SLICE_BITS : (p + 1) << SLICE_BITS]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(group + parts, pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(len(parts), t) for t in types[2:]]], names)

    return run


def _squeeze(cells: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(cells.astype(np.uint32).tobytes())


def _stretch(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)


def _add_slices(pdf):
    total = np.zeros(1 << SLICE_BITS, np.uint64)
    for blob in pdf["blob"]:
        total += _stretch(blob)
    return pdf[["part"]].head(1).assign(blob=[_squeeze(np.minimum(total, 0xFFFFFFFF))])


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks, as 16-bit ranks (logarithms of counts): 2**SKETCH_BITS * 4 bytes whatever the input.

    Shingles: rank of the count in excess of what chance puts into a cell, 0 for most. Words: rank of the count.
    """
    slices = 2 << (SKETCH_BITS - SLICE_BITS)
    near = parts.groupBy("part").applyInPandas(_add_slices, "part int, blob binary")
    far = near.select((F.col("part") % slices).alias("part"), "blob").groupBy("part").applyInPandas(_add_slices, "part int, blob binary")
    counts = np.zeros((slices, 1 << SLICE_BITS), np.uint32)
    for row in far.toLocalIterator():
        counts[row["part"]] = _stretch(row["blob"])
    counts = counts.reshape(2, -1)
    load = float(np.median(counts[0]))
    excess = np.maximum(counts[0] - (load + 5 * np.sqrt(load) + 1), 0)
    return np.concatenate([_rank(excess), _rank(counts[1])])


def _rank(counts: np.ndarray) -> np.ndarray:
    return np.rint(8 * np.log2(counts.astype(np.float32) + 1)).astype(np.uint16)


def prefix_length(sizes, percent: int):
    """Shingles of a set of which one at least is shared with any set over the threshold."""
    return np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)


def _prefixes(width: int, percent: int, sketch):
    names = ["h", "class_id", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ranks = sketch.value
        for _, texts in tokens.text_batches(batches):
            n, spelled = len(texts), tokens.words(texts)[:2]
            _, sizes, ids, _ = _sets(spelled, n, width)
            fresh = np.zeros(n, bool)
            for i, x in enumerate(ids.tolist()):
                if sizes[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keys, at = tokens.shingle_keys(*spelled, width)
            doc = np.repeat(np.arange(n), spelled[1])
            at = at[fresh[doc[at]]]
            rare, last = np.zeros(len(at), np.uint64), np.cumsum(spelled[1])[doc[at]] - 1
            for k in range(width):
                rare += np.where(at + k <= last, ranks[_cell(spelled[0][np.minimum(at + k, last)]) + (1 << SKETCH_BITS)], 0).astype(np.uint64)
            often = ranks[_cell(keys[at])].astype(np.uint64)
            # One number for order and identity: common shingles last, else by how rare their words are, then by hash.
            rank = np.minimum(np.where(often > 0, np.uint64(1024) + often, np.minimum(rare, np.uint64(1023))), np.uint64(2047))
            keys, kept = tokens.distinct(rank << np.uint64(53) | keys[at] >> np.uint64(11), doc[at], n)
            doc = np.repeat(np.arange(n), kept)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(kept) - kept, kept)
            use = place < prefix_length(sizes, percent)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(ids[doc[use]]), pa.array(sizes[doc[use]].astype(np.int32)), pa.array(place[use].astype(np.int32))], names)

    return run


def _place(doc_id: Column, class_id: Column) -> Column:
    """Key of a class's representative row; class ids are uniform, so it is a hash."""
    return class_id.bitwiseXOR(F.coalesce(doc_id, F.lit(0)))


def _fetch(width: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch, texts in tokens.text_batches(batches):
            keys, sizes, ids, _ = _sets(tokens.words(texts)[:2], len(texts), width)
            hit = (sizes > 0) & bloom.contains(shipped.value, batch.column("doc_id").fill_null(0).to_numpy() ^ ids)
            ends, rows = np.cumsum(sizes), []
            for i in np.flatnonzero(hit).tolist():
                if (key := (int(ids[i]), batch.column("doc_id")[i].as_py())) not in seen:
                    seen.add(key)
                    rows.append((*key, keys[ends[i] - sizes[i] : ends[i]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["class_id", "doc_id", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _near(n: Column, m: Column, percent: int) -> Column:
    """Length filter."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _room(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Positional filter: what can still be shared from places i and j on reaches the threshold."""
    return (100 + percent) * (1 + F.least(n - i, m - j) - 1) >= percent * (n + m)


def _apart(a: str, b: str) -> Column:
    """Least number of shingles that only one of two sets has: the ranges in which their sizes differ in parity."""
    return sum(F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in SIGNS)


def _suffix(n: str, m: str, a: str, b: str, percent: int) -> Column:
    """Suffix filter: sets that differ in more shingles than two sets over the threshold can are left out."""
    return (100 + percent) * _apart(a, b) <= (100 - percent) * (F.col(n) + F.col(m))


def _named(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that pass the suffix filter, with the documents that stand for the classes."""
    of = lambda k: classes.select(F.col("class_id").alias(k), F.col("doc_id").alias(f"{k}_doc"), F.col("n_shingles").alias(f"{k}_n"), *[F.col(s).alias(f"{k}_{s}") for s in SIGNS])
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.filter(_suffix("a_n", "b_n", "a_", "b_", percent)).select("a", "a_doc", "b", "b_doc")


class _Sets:
    """Whole shingle sets of the classes that have been candidates, in the shared folder; each is computed once."""

    def __init__(self, docs: DataFrame, width: int):
        self.docs, self.width, self.paths = docs, width, []

    def stored(self) -> DataFrame:
        return self.docs.sparkSession.read.schema("class_id bigint, doc_id bigint, shingles binary").parquet(*self.paths)

    def add(self, pairs: DataFrame) -> None:
        spark = self.docs.sparkSession
        wanted = pairs.select(F.col("a").alias("class_id"), F.col("a_doc").alias("doc_id")).union(pairs.select("b", "b_doc")).distinct()
        if self.paths:
            wanted = wanted.join(self.stored().select("class_id"), "class_id", "left_anti")
        wanted = materialize(spark, wanted, "wanted")
        if wanted.isEmpty():
            return
        shipped = spark.sparkContext.broadcast(bloom.build(wanted.select(_place(F.col("doc_id"), F.col("class_id")).alias("key")), "key"))
        sets = self.docs.select("doc_id", "text").mapInArrow(_fetch(self.width, shipped), "class_id bigint, doc_id bigint, shingles binary")
        self.paths.append(write_scratch(spark, sets, "sets"))

    def verified(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (a, a_doc, b, b_doc) whose whole sets reach the threshold."""
        self.add(pairs)
        if not self.paths:
            return pairs.select("a", "b")
        side = lambda k, name: self.stored().select(F.col("class_id").alias(k), F.col("doc_id").alias(f"{k}_doc"), F.col("shingles").alias(name))
        same = lambda k: (F.col(f"p.{k}") == F.col(f"s.{k}")) & F.col(f"p.{k}_doc").eqNullSafe(F.col(f"s.{k}_doc"))
        one = pairs.alias("p").join(side("b", "y").alias("s"), same("b")).select("p.a", "p.a_doc", "p.b", "y")
        both = one.alias("p").join(side("a", "x").alias("s"), same("a")).select("p.a", "p.b", "x", "y")
        return both.mapInArrow(_verify(percent), "a bigint, b bigint")


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a bucket, belong to different components and pass the filters.

    Rows outside the component with most rows of their bucket meet all rows of the bucket: at most twice the pairs of
    different components are looked at, however large a component is.
    """
    sizes = placed.groupBy("h", "c").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("h").agg(F.max_by("c", "k").alias("largest"))
    x = placed.join(largest, "h").filter("c <> largest").drop("largest").withColumnRenamed("class_id", "x")
    y = _right(placed).withColumnRenamed("c", "d").withColumn("len", F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)))
    return x.join(y, ["h", "len"]).filter((F.col("c") != F.col("d")) & _passes(percent)).select("x", "y")


def _right(rows: DataFrame) -> DataFrame:
    """The right side of a join: other names for what the filters compare."""
    names = {"class_id": "y", "n": "m", "pos": "j"} | {s: f"r_{s}" for s in SIGNS}
    return rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns])


def _placed_well(percent: int) -> Column:
    """Length and positional filter of a bucket's row against a row of _right."""
    return _near(F.col("n"), F.col("m"), percent) & _room(F.col("n"), F.col("pos"), F.col("m"), F.col("j"), percent)


def _passes(percent: int) -> Column:
    return _placed_well(percent) & _suffix("n", "m", "", "r_", percent)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id; component_id is the least doc_id reachable by links."""
    spark = docs.sparkSession
    tokens.bound_batches(spark)
    scanned = docs.select("doc_id", "text").mapInArrow(_classes(width), "part int, blob binary, doc_id bigint, n_shingles bigint, class_id bigint, " + ", ".join(f"{s} bigint" for s in SIGNS))
    scanned = materialize(spark, scanned, "classes")
    sketch = spark.sparkContext.broadcast(_sketch(scanned.filter("part IS NOT NULL").select("part", "blob")))
    members = scanned.filter("part IS NULL").select("doc_id", "n_shingles", "class_id", *SIGNS)
    classes = members.filter("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in ("n_shingles", *SIGNS)])
    classes = materialize(spark, classes, "class-table")

    entries = materialize(spark, docs.select("doc_id", "text").mapInArrow(_prefixes(width, percent, sketch), "h bigint, class_id bigint, n int, pos int"), "prefixes")
    buckets = entries.groupBy("h").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).filter("least <> most").select("h")
    shared = materialize(spark, entries.join(buckets, "h"), "buckets")

    # First round: every class against one of each of its buckets: that with most shared prefixes, which has few shingles
    # of its own and so is close to many.
    common = shared.groupBy("class_id").agg(F.count("*").alias("shares"))
    hubs = shared.join(common, "class_id").groupBy("h").agg(F.max_by("class_id", "shares").alias("class_id"))
    right = shared.join(hubs, ["h", "class_id"]).dropDuplicates(["h"]).select("h", F.col("class_id").alias("y"), F.col("n").alias("m"), F.col("pos").alias("j"))
    met = shared.join(right, "h").filter((F.col("class_id") != F.col("y")) & _placed_well(percent))
    tested = materialize(spark, _named(met.select(F.least("class_id", "y").alias("a"), F.greatest("class_id", "y").alias("b")).distinct(), classes, percent), "pairs")
    sets = _Sets(docs, width)
    links = materialize(spark, sets.verified(tested, percent), "links")
    label = components(links)

    # Second round: every pair that shares a bucket across the components made so far.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    placed = shared.join(label, F.col("class_id") == F.col("id"), "left").select("h", "class_id", "n", "pos", step.alias("len"), F.coalesce("component", "class_id").alias("c"))
    mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    placed = materialize(spark, placed.join(mixed, "h", "left_semi").join(classes.select("class_id", *SIGNS), "class_id"), "placed")
    found = _across(placed, percent).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    fresh = materialize(spark, _named(found.join(tested.select("a", "b"), ["a", "b"], "left_anti"), classes, percent), "pairs")
    if not fresh.isEmpty():
        links = materialize(spark, links.union(sets.verified(fresh, percent)), "links")
        label = components(links)

    named = classes.select("class_id", "doc_id").join(label, F.col("class_id") == F.col("id"), "left").select("class_id", "doc_id", F.coalesce("component", "class_id").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "c").select("class_id", "component_id")
    return members.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id")).join(ids, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_shingles, component_id; three words and 90 percent."""
    return near_duplicates(docs, 3, 90)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""
