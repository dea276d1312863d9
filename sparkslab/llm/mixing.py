"""Mixing sources by temperature, realised as budgeted block permutations.

Source shares p are raised to an exponent in 0..1 and normalised.  The exponent
is bisected until the weights meet a target: an entropy, or the most often a
source may be repeated.  A source's target tokens are then taken as whole
passes over it and one partial pass: its documents stand in blocks of about
equal size, each pass is a seeded permutation of the blocks (and of the
documents in each), and the partial pass takes blocks in that order until its
budget is met, the last one document by document.  ``schedule`` says where each
use of a document stands.

Rows alike in id, text and source are one unit with that many copies, so the
edge of the budget may fall between them and reruns agree.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

#: The most often any source is repeated.
MAX_REPEATS = 2.0
#: Tokens in a block, about; a source has at most so many blocks, and larger ones if need be.
BLOCK_TOKENS = 200_000
MAX_BLOCKS = 65_536
SEED = 17
#: Bisection steps in one pass over the sources, and passes.
LEVELS, PASSES = 5, 8


def token_count(text: Column) -> Column:
    """Words between white space."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(clean == "", F.lit(0)).otherwise(F.length(clean) - F.length(F.translate(clean, " ", "")) + 1).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs) with null sources under an empty name; one row a source."""
    return docs.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, repetition) of the weights under each exponent; repetition: the largest by the smallest weight for a token."""
    log_p = F.ln("tokens") - F.ln("total")
    columns = []
    for k, a in enumerate(exponents):
        columns += [F.sum(F.exp(a * log_p)).alias(f"z{k}"), F.sum(F.exp(a * log_p) * a * log_p).alias(f"e{k}"), F.max((a - 1) * log_p).alias(f"h{k}"), F.min((a - 1) * log_p).alias(f"l{k}")]
    row = sources.where("tokens > 0").agg(*columns).first()
    out = []
    for k in range(len(exponents)):
        z = row[f"z{k}"]
        out.append((math.log(z) - row[f"e{k}"] / z, math.exp(row[f"h{k}"] - row[f"l{k}"])) if z else (0.0, 1.0))
    return out


def bisect_exponent(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The smallest exponent in 0..1 that keeps repetition within ``max_repeats``, or the largest that reaches ``entropy`` (nats).

    Both measures fall as the exponent rises, so the middle of an interval tells
    which half to keep; one pass over the sources (with columns tokens, total)
    evaluates all the middles that ``LEVELS`` steps can ask for.  An unreachable
    entropy gives 0, no source gives 1.
    """
    by_entropy = entropy is not None
    held = (lambda m: m[0] >= entropy) if by_entropy else (lambda m: m[1] <= max_repeats)
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        parts = 1 << LEVELS
        grid = [low + (high - low) * i / parts for i in range(parts + 1)]
        found = _measures(sources, grid)
        i, j = 0, parts
        if by_entropy:
            if not held(found[0]):
                return 0.0
            if held(found[parts]):
                return grid[parts]
        elif held(found[0]):
            return grid[0]
        while j - i > 1:
            m = (i + j) // 2
            if held(found[m]) == by_entropy:
                i = m
            else:
                j = m
        low, high = grid[i], grid[j]
    return low if by_entropy else high


def _rid(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def plan(docs: DataFrame, budget: float | None = None, entropy: float | None = None, max_repeats: float = MAX_REPEATS, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text, source) as units: rid, doc_id, source, n_tokens, copies, weight, whole, extra, block.

    A unit is used ``whole`` times for each of its copies, and ``extra`` of the
    copies once more.  Without a ``budget`` (tokens) it is the least one with
    which every source is used at least once, so that no document goes.  Null
    sources are one source of their own; a document without tokens goes with the
    documents before it; a source without tokens has weight 0 and is used once.
    Other columns are ignored.
    """
    rows = docs.select(_rid(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), token_count(F.col("text").cast("string")).alias("n"))
    units = stage(rows.groupBy("rid", "doc_id", "source", "no_source").agg(F.max("n").alias("n"), F.count("*").alias("copies")), "mix-units")
    sums = units.groupBy("source", "no_source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = stage(sums.withColumn("total", F.lit(max(total, 1)).cast("double")), "mix-sources")
    a = bisect_exponent(sources, entropy, None if entropy is not None else max_repeats)
    raw = F.when(F.col("tokens") > 0, F.exp(a * (F.ln("tokens") - F.ln("total")))).otherwise(0.0)
    norm = sources.agg(F.sum(raw).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw)).alias("b")).first()
    z = norm.z or 1.0
    spend = budget if budget is not None else (norm.b or 0.0) * z
    passes = F.when(F.col("tokens") > 0, F.lit(float(spend)) * raw / z / F.col("tokens")).otherwise(1.0)
    shares = sources.select("source", "no_source", "tokens", (raw / z).alias("weight"), F.round(passes, 9).alias("passes"))
    shares = shares.select("*", F.floor("passes").cast("long").alias("whole"), F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / block_tokens))).cast("long").alias("blocks"))
    shares = stage(shares.withColumn("left", F.round((F.col("passes") - F.col("whole")) * F.col("tokens")).cast("long")), "mix-shares")
    keyed = units.join(shares, ["source", "no_source"]).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("blocks"))).withColumn("all", F.col("n") * F.col("copies"))
    blocks = stage(keyed.groupBy("source", "no_source", "block", "whole", "left").agg(F.sum("all").alias("size")), "mix-blocks")
    # the partial pass takes its permutation's first blocks
    before = Window.partitionBy("source", "no_source").orderBy(_order(F.col("whole"), seed), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("source", "no_source", "block", "size", (F.col("left") - F.coalesce(F.sum("size").over(before), F.lit(0))).alias("room"))
    used = keyed.join(placed, ["source", "no_source", "block"])
    edge = (F.col("room") > 0) & (F.col("room") < F.col("size"))
    inside = Window.partitionBy("source", "no_source", "block").orderBy(_turn(F.col("whole"), seed), "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    cut = used.where(edge).withColumn("room", F.col("room") - F.coalesce(F.sum("all").over(inside), F.lit(0)))
    fits = F.when(F.col("n") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(F.col("room") / F.col("n"))))).when(F.col("room") >= 0, F.col("copies")).otherwise(0)
    cut = cut.withColumn("extra", fits.cast("long"))
    rest = used.where(~edge).withColumn("extra", F.when(F.col("room") >= F.greatest(F.col("size"), F.lit(1)), F.col("copies")).otherwise(0).cast("long"))
    return cut.unionByName(rest).select("rid", "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), F.col("n").alias("n_tokens"), "copies", "weight", "whole", "extra", "block")


def _order(number: Column, seed: int) -> Column:
    """What a source's blocks are sorted by in a pass."""
    return F.xxhash64("block", "source", number, F.lit(seed))


def _turn(number: Column, seed: int) -> Column:
    """What a block's documents are sorted by in a pass."""
    return F.xxhash64("rid", number, F.lit(seed + 1))


def schedule(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, pass, place, turn: one row for each use of each row of ``docs``.

    Passes are numbered from 0.  Within a pass over its source, a use stands in
    the block at ``place`` (from 1) and in this by ``turn``, doc_id and copy.
    See ``plan`` for nulls and repeated rows.
    """
    units = stage(plan(docs, seed=seed, **how), "mix-plan")
    whole = F.transform(F.expr("if(whole > 0, sequence(0L, whole - 1), array())"), lambda i: F.struct(i.cast("long").alias("number"), F.col("copies").alias("times")))
    last = F.when(F.col("extra") > 0, F.array(F.struct(F.col("whole").alias("number"), F.col("extra").alias("times")))).otherwise(F.array().cast("array<struct<number:bigint,times:bigint>>"))
    uses = units.select("*", F.explode(F.concat(whole, last)).alias("use")).select("*", F.col("use.number").alias("pass"), F.col("use.times").alias("times"))
    known = uses.select("source", "block", "pass").distinct()
    place = known.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "block", "pass")
    place = place.withColumn("place", F.row_number().over(Window.partitionBy("source", "no_source", "pass").orderBy(_order(F.col("pass"), seed), "block")))
    uses = uses.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    out = uses.join(place, ["source", "no_source", "block", "pass"]).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "n_tokens", "weight", "pass", "place", _turn(F.col("pass"), seed).alias("turn"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as ``plan`` uses it; all columns stay, of any name."""
    fresh = uuid.uuid4().hex
    name = lambda c: f"{c}_{fresh}"
    units = stage(plan(docs, **how), "mix-plan")
    used = units.select(*[F.col(c).alias(name(c)) for c in ("rid", "doc_id", "source", "copies", "whole", "extra")])
    same = (_rid(docs) == used[name("rid")]) & docs["doc_id"].cast("long").eqNullSafe(used[name("doc_id")]) & docs["source"].cast("string").eqNullSafe(used[name("source")])
    joined = docs.join(used, same)
    halved = (F.col(name("extra")) > 0) & (F.col(name("extra")) < F.col(name("copies")))
    times = F.col(name("whole")) + (F.col(name("extra")) > 0).cast("long")
    out = joined.where(~halved).withColumn(name("times"), times)
    if not units.where("extra > 0 and extra < copies").isEmpty():  # at most one unit of a source
        number = F.row_number().over(Window.partitionBy(name("rid"), name("doc_id"), name("source")).orderBy(name("rid")))
        some = joined.where(halved).withColumn(name("times"), number)
        out = out.unionByName(some.withColumn(name("times"), F.col(name("whole")) + (F.col(name("times")) <= F.col(name("extra"))).cast("long")))
    return out.where(F.col(name("times")) > 0).withColumn(name("copy"), F.explode(F.expr(f"sequence(1L, `{name('times')}`)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
