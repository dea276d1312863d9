"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Documents and benchmark items are cut into five-word shingles.  A window of an
item's size that starts at a shingle of the item (or ends with the document)
is a window to test: the best window of any document can be slid, without loss,
to start at a shingle it shares with the item.  Windows of equal content are
tested once.  Each window and item has a 64-bit SimHash of its shingles; the
fingerprints are cut into blocks, the items' blocks are indexed with all their
neighbours, and windows look their blocks up among items of their size, which
finds every pair within the radius.  Pairs found are verified by the exact
weighted similarity of their shingles.  An item of fewer than five words is
found wherever a document has its words in a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

WORDS = 5
THRESHOLD = 0.8
#: Fingerprints differ in about 10 bits at the threshold, with a deviation of 3.
RADIUS = 24
BLOCKS = 16
BITS = 64
#: Benchmark shingles up to which the list of them is broadcast (a long each); beyond, it is joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-cased runs between white space; null and blank texts have none."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_list(words: Column) -> Column:
    """Hashes of all runs of five words, in order; a shorter text is one shingle."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) >= WORDS, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def short_runs(words: Column, lengths: list[int]) -> Column:
    """The distinct runs of these numbers of words, joined by blanks."""

    def runs(w: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.array_distinct(F.flatten(F.array(*[runs(w, n) for n in lengths]))))


def simhash(shingles: Column) -> Column:
    """Bit k is set where more of the shingles have it set than not."""
    half = F.size(shingles) / 2.0
    ones = F.aggregate(
        shingles,
        F.array_repeat(F.lit(0), BITS),
        lambda acc, h: F.zip_with(acc, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda a, k: a + F.getbit(h, k).cast("int")),
    )
    return F.aggregate(F.transform(ones, lambda c, k: F.when(c > half, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _width(blocks: int) -> int:
    return -(-BITS // blocks)


def block_keys(fingerprint: Column, blocks: int = BLOCKS) -> Column:
    """Each block's bits with the block's number."""
    width = _width(blocks)
    mask = (1 << width) - 1
    return F.array(*[F.shiftrightunsigned(fingerprint, b * width).bitwiseAND(F.lit(mask).cast("long")) + F.lit(b << (width + 1)).cast("long") for b in range(blocks) if b * width < BITS])


def neighbour_keys(fingerprint: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """All keys whose block differs in at most radius / blocks bits: by the pigeonhole, one is any near fingerprint's."""
    width = _width(blocks)
    used = -(-BITS // width)
    near = [m for m in range(1 << width) if m.bit_count() <= radius // used]
    return F.flatten(F.transform(block_keys(fingerprint, blocks), lambda key: F.transform(F.array(*[F.lit(m).cast("long") for m in near]), lambda m: key.bitwiseXOR(m))))


def _repeats(x: Column) -> Column:
    """Of a sorted list, what is left when each value goes once."""
    return F.filter(x, lambda v, i: (i > 0) & (F.get(x, i - 1) == v))


def _shared(x: Column, y: Column, levels: int = 3) -> Column:
    """How many values two sorted lists share, each as often as both have it.

    Each level counts the distinct values of both by hashing and goes on with
    their repeats; the last one counts those that stand more often one by one.
    """
    if levels:
        return F.size(F.array_intersect(x, y)) + let(_repeats(x), lambda u: F.when(F.size(u) == 0, 0).otherwise(let(_repeats(y), lambda v: F.when(F.size(v) == 0, 0).otherwise(_shared(u, v, levels - 1)))))
    count = lambda of, h: F.size(F.filter(of, lambda v: v == h))
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, h: acc + F.least(count(x, h), count(y, h)))


def weighted_similarity(x: Column, y: Column) -> Column:
    """Sum of least over sum of largest counts, of two sorted shingle lists."""
    return let(_shared(x, y), lambda n: n / (F.size(x) + F.size(y) - n))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, item_id, similarity: each document's best window for each item it holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored.  Null, empty and blank texts hold nothing and are held by
    nothing.  An item of fewer than five words is held, with similarity 1, where
    its words stand in a row.  A document shorter than an item is one window.  Rows that share a doc_id count as one
    document, and repeated items are found under each of their ids.  A row
    without an id is left out.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_list(F.col("text").cast("string")).alias("words"))
    items = items.select("item_id", F.when(F.size("words") < WORDS, F.col("words")).alias("short"), shingle_list(F.col("words")).alias("s"))
    items = stage(items.select("item_id", "short", F.array_sort("s").alias("s"), F.size("s").alias("len"), simhash(F.col("s")).alias("print")), "decon-items").where("len > 0")
    short = items.where("short is not null").select("item_id", F.array_join("short", " ").alias("run"), F.size("short").alias("n"))
    lengths = sorted(r.n for r in short.select("n").distinct().collect())
    items = items.where("short is null").drop("short")
    seeds = items.select(F.explode(F.array_distinct("s")).alias("h"), "len").distinct()
    if seeds.count() <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    shingled = shingle_list(word_list(F.col("text")))
    # where a document and an item share a shingle: the long lists stay behind
    at = rows.select("doc_id", F.posexplode(shingled).alias("at", "h")).join(seeds, "h")
    found = at.groupBy("doc_id").agg(F.collect_set(F.struct("at", "len")).alias("found"))
    # a window does not run over the end
    first = lambda x: F.greatest(F.lit(0), F.least(x["at"], F.size("s") - x["len"]))
    starts = F.array_distinct(F.transform("found", lambda x: F.struct(first(x).alias("at"), x["len"].alias("len"))))
    cut = F.transform(starts, lambda x: F.struct(x["len"].alias("len"), F.array_sort(F.slice("s", x["at"] + 1, x["len"])).alias("w")))
    windows = rows.join(found, "doc_id").select("doc_id", "found", shingled.alias("s")).select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.len", "x.w")
    windows = windows.select("doc_id", "len", F.xxhash64("w", "len").alias("wid"), "w")
    windows = stage(windows.dropDuplicates(["doc_id", "wid"]), "decon-windows")
    prints = stage(windows.select("wid", "len", "w").dropDuplicates(["wid"]).withColumn("print", simhash(F.col("w"))), "decon-prints")
    index = items.select("item_id", "len", F.explode(F.array_distinct(neighbour_keys(F.col("print"), blocks, radius))).alias("key"))
    probes = prints.select("wid", "len", F.explode(block_keys(F.col("print"), blocks)).alias("key"))
    pairs = probes.join(index, ["len", "key"]).select("wid", "item_id").distinct()
    theirs = items.select("item_id", F.col("s").alias("item"), F.col("print").alias("item_print"))
    near = pairs.join(prints.select("wid", "w", "print"), "wid").join(theirs, "item_id").where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    hits = stage(near.select("wid", "item_id", weighted_similarity(F.col("w"), F.col("item")).alias("similarity")).where(F.col("similarity") >= threshold), "decon-hits")
    held = windows.select("doc_id", "wid").join(hits, "wid").select("doc_id", "item_id", "similarity")
    if lengths:
        if short.count() <= BROADCAST_SHINGLES:
            short = F.broadcast(short)
        runs = rows.select("doc_id", F.explode(short_runs(word_list(F.col("text")), lengths)).alias("run"))
        held = held.union(runs.join(short, "run").select("doc_id", "item_id", F.lit(1.0).alias("similarity")))
    return held.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, of any name; a row without an id stays."""
    hit = f"hit_{uuid.uuid4().hex}"
    hits = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, docs["doc_id"].cast("long") == F.col(hit), "left_anti")
