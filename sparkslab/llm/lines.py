"""Line deduplication by distinct-site spread.

Each line's hash has a HyperLogLog sketch of the sites it stands on; sketches
of partitions merge by aggregation.  A line far above the threshold is
boilerplate, one far below is not; for those near it, sites are counted
exactly.  Boilerplate lines are then removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

#: A line on at least so many sites is boilerplate.
SITES = 5
#: log2 of a sketch's registers, and its relative standard error.
LG_K = 12
ERROR = 1.04 / (1 << (LG_K // 2))
#: Standard errors around the threshold within which sites are counted exactly.
BAND = 6
#: Shards of a boilerplate line's occurrences, so that a line on a third of all rows is spread.
SALT = 32
#: Lines up to which the list of them (a long each) is broadcast.
BROADCAST_LINES = 200_000


def lines_of(text: Column) -> Column:
    """A text's lines; null has none."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    """64-bit hash of a line without the blanks around it; null for a blank line."""
    clean = F.trim(line)
    return F.when(clean != "", F.xxhash64(clean))


def _marked(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` (with doc_id) whose hash is among ``found``: by a broadcast if these are few, else by a join that spreads each hash."""
    if found.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(found), "h")
    salted = found.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted.hint("merge"), ["h", "salt"]).drop("salt")


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(h): hashes of lines that stand on at least ``sites`` distinct non-null sources."""
    lines = docs.where("source is not null").select("doc_id", "source", F.explode(F.transform(lines_of(F.col("text")), line_hash)).alias("h")).where("h is not null")
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("source", LG_K).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("estimate"))
    low, high = sites * (1 - BAND * ERROR) - 1, sites * (1 + BAND * ERROR) + 1
    spread = stage(spread.where(F.col("estimate") >= low), "lines-spread")
    near = spread.where(F.col("estimate") <= high).select("h")
    # repeats of a line on a site go before any exchange, so a hot line is as many rows as it has sites
    exact = _marked(lines, near).select("h", "source").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h")
    return spread.where(F.col("estimate") > high).select("h").union(exact)


def remove_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_md5: every document without its boilerplate lines.

    Lines are compared without the blanks around them; blank lines are never
    removed.  A null text is empty, a null source counts as no site, and
    repeated rows give repeated results (a row is told apart by its id and
    text).  The kept lines are joined as they stood; the work is linear in a
    text's lines.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    found = stage(boilerplate(rows, sites), "lines-boilerplate")
    lines = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.posexplode(F.transform(lines_of(F.col("text")), line_hash)).alias("at", "h")).where("h is not null")
    gone = _marked(lines, found).groupBy("rid").agg(F.collect_set("at").alias("gone"))
    joined = rows.withColumn("rid", F.xxhash64("doc_id", "text")).join(gone, "rid", "left")
    places = F.sequence(F.lit(0), F.size("all") - 1)
    kept_at = F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone")))
    kept = joined.select("doc_id", "gone", lines_of(F.col("text")).alias("all")).select("doc_id", F.size("all").alias("n_lines"), "all", kept_at.alias("at"))
    kept = kept.select("doc_id", "n_lines", F.when(F.size("at") == F.col("n_lines"), F.col("all")).otherwise(F.transform("at", lambda i: F.get("all", i))).alias("kept"))
    joined_text = F.array_join("kept", "\n")
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.length(joined_text).cast("long").alias("n_chars"), F.md5(joined_text).alias("text_md5"))


def oracle_sql(sites: int = SITES) -> str:
    """The same by exact counts."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, row_number() OVER (ORDER BY doc_id, text, source) AS rid FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY trim(line, ' ') HAVING count(DISTINCT source) >= {sites}),
k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE trim(line, ' ') IN (SELECT line FROM b)) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE trim(line, ' ') NOT IN (SELECT line FROM b)), '') AS kept FROM l GROUP BY rid)
SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars, md5(kept) AS text_md5 FROM d JOIN k USING (rid)"""
