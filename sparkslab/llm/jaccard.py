"""N-gram Jaccard self-join with a MinHash LSH forest.

Equal shingle sets are collapsed first.  Each remaining set's signature is cut
into ``trees`` strings of ``depth`` values; a tree is the trie of these
strings, and two sets meet where their strings share a prefix.

Sets meet by their longest prefixes first, and all pairs that meet are verified
exactly.  A signature then keeps its prefixes if its expected recall reaches
the target: the links it has, against these plus what they say is missing (a
link of similarity s is found with a known chance, see ``chance``) and one
unseen link at the threshold.  The others shorten their prefixes, and each
meets all sets there that it has not met before, until even a signature without
any link has the target recall.  So members of a crowd of near copies, which
have many links, stop early, and what is unsettled goes on.

A small node gives its pairs as rows.  A large one is dealt into blocks, and
blocks are verified against each other; a pair of blocks gives only what its
members have in it, not the pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.llm import shingles
from sparkslab.operators.components import connected_components
from sparkslab.plans.stage import stage

THRESHOLD = 0.8
TREES = 20
DEPTH = 6
#: A pair at the threshold is to meet with at least this probability.
RECALL = 0.9999
#: A node of at most so many sets gives all its pairs as rows; a larger one is verified block by block.
SMALL = 16
#: About the sets, and the bytes of their hashes, in a block of a large node.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
#: Pairs of two blocks up to which they are verified one by one, and hashes counted in one product beyond.
FEW, SLICE = 1000, 4096
#: Ids of documents to verify up to which the list of them is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
SEED = 41
#: Values by which a prefix is shortened at a time.
STEP = 2


def chance(similarity, length: int, trees: int):
    """How likely two sets share a prefix of ``length`` in one tree at least."""
    return 1 - (1 - similarity**length) ** trees


def prefix_lengths(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """The lengths that prefixes are shortened to: with the last, a pair at the threshold meets with the target recall."""
    k = depth
    while k > 1 and chance(threshold, k, trees) < recall:
        k -= 1
    return [*range(depth, k, -STEP), k]


def set_key(hashes: np.ndarray) -> bytes:
    """What a shingle set goes by."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def _signatures(trees: int, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shingles.permutations(trees * depth, seed)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                keys, sigs, sizes = [], [], []
                for text in part.column(2):
                    h = shingles.shingle_hashes(text.as_py())
                    sizes.append(len(h))
                    keys.append(set_key(h) if len(h) else None)
                    sigs.append(shingles.minhash(h, a, b).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "rid", "key", "n_shingles", "sig"])

    return run


def _values(trees: int, depth: int, lengths: list[int]):
    """Signature bytes to one row for each tree, with the prefix of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(s, np.int32) for s in batch.column(1).to_pylist()]).reshape(-1, trees, depth)
            n = batch.num_rows
            h = np.broadcast_to(np.arange(trees, dtype=np.uint64), (n, trees)).copy()
            cols = {}
            for d in range(depth):
                h = shingles._mix(h * shingles._ODD[0] + sig[:, :, d].astype(np.int64).view(np.uint64) + shingles._ODD[1])
                cols[d + 1] = pa.array(h.view(np.int64).ravel())
            nodes = np.repeat(np.asarray(batch.column(0)), trees)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *(cols[k] for k in lengths)], names=["node", *(f"p{k}" for k in lengths)])

    return run


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(i).to_pylist() for i in (2, 3))
        found = np.array([shingles.jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(left, right, strict=True)], dtype=float)
        keep = pa.array(found >= threshold)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(found[found >= threshold])], names=["src", "dst", "similarity"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each left set shares with each right set."""
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    if not len(shared):
        return out
    placed = []
    for f, side in zip(flat, (left, right), strict=True):
        at = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == f)
        hit = hit[np.argsort(at[hit], kind="stable")]
        placed.append((at[hit], np.repeat(np.arange(len(side)), [len(x) for x in side])[hit], len(side)))
    for i in range(0, len(shared), SLICE):
        dense = []
        for at, row, n in placed:
            lo, hi = np.searchsorted(at, (i, i + SLICE))
            m = np.zeros((n, min(SLICE, len(shared) - i)), np.float32)
            m[row[lo:hi], at[lo:hi] - i] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _similar(threshold: float, want: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Similarities of the wanted pairs that reach the threshold; 0 for the rest."""
    rows, cols = np.nonzero(want)
    found = np.zeros(want.shape)
    if len(rows) <= FEW:
        found[rows, cols] = [shingles.jaccard(left[i], right[j]) for i, j in zip(rows, cols, strict=True)]
    else:
        both = _common(left, right)
        found = both / (np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both)
    return np.where(want & (found >= threshold), found, 0.0)


def _roots(ids: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """The smallest id that each member reaches by the links."""
    root, seen = ids.copy(), np.zeros(len(ids), bool)
    for s in np.argsort(ids):
        front = np.array([] if seen[s] else [s], int)
        seen[s] = True
        while len(front):
            root[front] = ids[s]
            front = np.flatnonzero(adjacent[front].any(axis=0) & ~seen)
            seen[front] = True
    return root


def _crowd(threshold: float, length: int, trees: int):
    """Two blocks of a large node (or one with itself) to a row for each linked member: its root here, its links and their doubt.

    A pair that shares several large nodes counts in the one with the smallest
    prefix only, and one that met by a longer prefix doesn't count again.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, i, j = (k.as_py() for k in key)
        block, ids, active = (np.asarray(table.column(c)) for c in ("block", "node", "active"))
        hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        tops = [np.array([t for t in x if t < p], np.int64) for x in table.column("tops").to_pylist()]
        seen = [np.array(x, np.int64) for x in table.column("seen").to_pylist()]
        l, r = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = np.zeros((len(ids), len(ids)))
        if len(l) and len(r):
            want = (_common([tops[k] for k in l], [tops[k] for k in r]) == 0) & (_common([seen[k] for k in l], [seen[k] for k in r]) == 0)
            want &= active[l][:, None] | active[r]
            if i == j:
                want = np.triu(want, 1)
            found[np.ix_(l, r)] = _similar(threshold, want, [hashes[k] for k in l], [hashes[k] for k in r])
            found = np.maximum(found, found.T)
        links = (found > 0).sum(axis=1)
        some = np.flatnonzero(links)
        found = found[np.ix_(some, some)]
        doubt = np.where(found > 0, 1 / chance(np.maximum(found, threshold), length, trees) - 1, 0.0).sum(axis=1)
        return pa.table({"src": ids[some], "dst": _roots(ids[some], found > 0), "links": links[some].astype(np.int64), "doubt": doubt})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            made = [shingles.shingle_hashes(t.as_py()).astype("<u8") for t in batch.column(0).slice(i, 1000)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in made], pa.binary()), pa.array([h.tobytes() for h in made], pa.binary())], names=["key", "hashes"])


class JaccardJoin:
    """One self-join; ``classes`` is its result.

    Rows with a null id or without words are in no set.  A set goes by a number
    of its own, so rows that share an id and differ in their texts are apart.
    """

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, seed: int = SEED) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.threshold, self.trees, self.depth, self.recall, self.seed = threshold, trees, depth, recall, seed
        self.lengths = prefix_lengths(threshold, trees, depth, recall)
        signed = self.docs.select("doc_id", F.xxhash64("text").alias("rid"), "text").mapInArrow(_signatures(trees, depth, seed), "doc_id long, rid long, key binary, n_shingles long, sig binary")
        self.signed = stage(signed, "jaccard-signatures")
        first = F.struct("doc_id", "rid")
        groups = self.signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
        # numbers are unique, and fixed by being written
        self.groups = stage(groups.select("key", F.monotonically_increasing_id().alias("node"), "first", "copies", "sig"), "jaccard-groups")

    def forest(self) -> DataFrame:
        """(node, p<length>...): each set's prefixes in each tree where its shortest is shared."""
        prefixes = ", ".join(f"p{k} long" for k in self.lengths)
        made = stage(self.groups.select("node", "sig").mapInArrow(_values(self.trees, self.depth, self.lengths), f"node long, {prefixes}"), "jaccard-forest")
        last = f"p{self.lengths[-1]}"
        tops = made.groupBy(last).agg(F.count("*").alias("n")).where("n > 1")
        return stage(made.join(tops.select(last), last), "jaccard-shared")

    def meeting(self, forest: DataFrame, length: int, settled: DataFrame | None) -> DataFrame:
        """(p, node, active, n): the shared nodes at this length that have an unsettled member."""
        rows = forest.select("node", F.col(f"p{length}").alias("p"))
        if settled is None:
            rows = rows.withColumn("active", F.lit(True))
        else:
            rows = rows.join(settled.select("node", F.lit(False).alias("active")), "node", "left").withColumn("active", F.coalesce("active", F.lit(True)))
        tops = rows.groupBy("p").agg(F.count("*").alias("n"), F.max("active").alias("any")).where("n > 1 and any")
        return stage(rows.join(tops.select("p", "n"), "p"), "jaccard-meeting")

    def candidates(self, meeting: DataFrame, marks: DataFrame) -> DataFrame:
        """(a, b), a < b, of distinct sets that meet in small nodes, in no large one, and did not meet before."""
        small = meeting.where(F.col("n") <= SMALL).groupBy("p").agg(F.sort_array(F.collect_set(F.struct("node", "active"))).alias("all")).select("all").distinct()
        pairs = small.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
        pairs = pairs.where("x.active or y.active").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        left, right = (marks.select(F.col("node").alias(c), F.col("tops").alias(f"tops_{c}"), F.col("seen").alias(f"seen_{c}")) for c in "ab")
        met = F.coalesce(F.arrays_overlap("tops_a", "tops_b"), F.lit(False)) | F.coalesce(F.arrays_overlap("seen_a", "seen_b"), F.lit(False))
        return pairs.join(left, "a", "left").join(right, "b", "left").where(~met).select("a", "b")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, bytes, hashes): the whole shingle sets of the nodes."""
        needed = stage(self.groups.join(nodes.distinct(), "node").select("node", "key", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid")), "jaccard-needed")
        ids = needed.select("doc_id", "rid")
        if needed.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        text = self.docs.withColumn("rid", F.xxhash64("text")).join(ids, ["doc_id", "rid"], "left_semi")
        made = text.select("text").mapInArrow(_sets, "key binary, hashes binary")
        # a row that stands twice gives its set twice
        return stage(made.join(needed.select("node", "key"), "key").groupBy("node").agg(F.min("hashes").alias("hashes")).select("node", F.length("hashes").alias("bytes"), "hashes"), "jaccard-sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(src, dst, similarity) of the pairs that reach the threshold, by their whole shingle sets."""
        left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        threshold = self.threshold
        return stage(both.mapInArrow(lambda it: _verify(threshold, it), "src long, dst long, similarity double"), "jaccard-links")

    def crowded(self, large: DataFrame, marks: DataFrame, sets: DataFrame, length: int) -> DataFrame:
        """(src, dst, links, doubt): what the pairs with an unsettled member of each large node give, by blocks; see ``_crowd``."""
        sized = large.join(sets.select("node", "bytes"), "node")

        def blocks(of):
            count, size = F.sum(F.when(of, 1).otherwise(0)), F.sum(F.when(of, F.col("bytes")).otherwise(0))
            return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(size / BLOCK_BYTES))

        counted = sized.groupBy("p").agg(blocks(F.col("active")).alias("open"), blocks(~F.col("active")).alias("shut"))
        place = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
        dealt = large.join(counted, "p").select("p", "node", "active", "open", "shut", F.when(F.col("active"), place("open")).otherwise(F.col("open") + place("shut")).alias("block"))
        # settled blocks need not meet each other
        others = F.expr("sequence(0L, if(active, open + shut, open) - 1)")
        dealt = dealt.select("p", "node", "active", "block", F.explode(others).alias("other"))
        dealt = dealt.select("p", "node", "active", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        full = dealt.join(sets, "node").join(marks, "node").select("p", "i", "j", "block", "node", "active", "hashes", "tops", "seen")
        return stage(full.groupBy("p", "i", "j").applyInArrow(_crowd(self.threshold, length, self.trees), "src long, dst long, links long, doubt double"), "jaccard-crowds")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(node, degree) of all verified links between different sets, and the components they make."""
        forest = self.forest()
        sets = self.sets(forest.select("node"))
        ends, edges, settled = [], [], None
        for k, length in enumerate(self.lengths):
            meeting = self.meeting(forest, length, settled)
            large = meeting.where(F.col("n") > SMALL).select("p", "node", "active").distinct()
            before = F.array_distinct(F.flatten(F.collect_set(F.array(*[f"p{n}" for n in self.lengths[:k]])))) if k else F.array().cast("array<bigint>")
            seen = forest.join(meeting.select("node").distinct(), "node").groupBy("node").agg(before.alias("seen")) if k else meeting.select("node").distinct().withColumn("seen", before)
            tops = large.groupBy("node").agg(F.collect_set("p").alias("tops"))
            marks = stage(seen.join(tops, "node", "left").select("node", "seen", F.coalesce("tops", F.array().cast("array<bigint>")).alias("tops")), "jaccard-marks")
            few, many = self.verified(stage(self.candidates(meeting, marks), "jaccard-pairs"), sets), self.crowded(large, marks, sets, length)
            doubt = 1 / (1 - F.pow(1 - F.pow("similarity", F.lit(length)), F.lit(self.trees))) - 1
            ends.append(few.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(1).cast("long").alias("links"), doubt.alias("doubt")))
            ends.append(many.select(F.col("src").alias("node"), "links", "doubt"))
            edges += [few.select("src", "dst"), many.select("src", "dst")]
            if length != self.lengths[-1]:
                unseen = 1 / chance(self.threshold, length, self.trees) - 1
                known = _union(ends).groupBy("node").agg(F.sum("links").alias("links"), F.sum("doubt").alias("doubt"))
                settled = stage(known.where(F.col("links") >= self.recall * (F.col("links") + F.col("doubt") + unseen)).select("node"), "jaccard-settled")
        return _union(ends).groupBy("node").agg(F.sum("links").alias("degree")), connected_components(_union(edges))

    def decisions(self) -> DataFrame:
        """doc_id, rid (a hash of the text), class_id, n_links, n_copies, first: one row for each row of the documents.

        ``first`` marks the rows that have the smallest (doc_id, rid) of their class.
        """
        degree, parts = self.links()
        named = self.groups.join(parts, "node", "left").join(degree, "node", "left").select("key", "copies", "first", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        named = stage(named, "jaccard-named")
        heads = named.groupBy("component").agg(F.min("first").alias("head"))
        named = named.join(heads, "component").select("key", "copies", "head", "degree")
        joined = self.signed.select("doc_id", "rid", "key").join(named, "key", "left")
        own = F.coalesce("head", F.struct("doc_id", "rid"))
        first = F.coalesce((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.rid") == F.col("rid")), F.lit(True))
        return joined.select("doc_id", "rid", F.when(F.col("doc_id").isNotNull(), own["doc_id"]).alias("class_id"), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), (F.col("doc_id").isNull() | first).alias("first"))

    def classes(self) -> DataFrame:
        """doc_id, class_id, n_links, n_copies: one row for each row of the documents.

        A class is a connected component of texts linked by a similarity of the
        threshold or more, named by its smallest id (so two classes have one
        name if rows of one id are the first of both).  n_copies counts the rows
        with the same shingle set, n_links these but the row itself, plus its
        verified links to other sets.  A text without words is a class of its
        own, without links; a null id has no class.
        """
        return self.decisions().select("doc_id", "class_id", "n_links", "n_copies")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near duplicates among ``docs`` (doc_id, text); see ``JaccardJoin.classes``."""
    return JaccardJoin(docs, threshold).classes()


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near duplicates, with all its columns: the one with the smallest id.

    Of rows alike in id and text one stays; rows without an id, and those
    without words but of an id of their own, stay.  Columns of any name pass.
    """
    found = JaccardJoin(docs, threshold).decisions().where("doc_id is not null")
    doc, text = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    gone, rid = f"gone_{uuid.uuid4().hex}", f"rid_{uuid.uuid4().hex}"
    keyed = docs.withColumn(rid, text)
    lost = found.where("not first").select(F.col("doc_id").alias(gone), F.col("rid").alias(f"{gone}_rid")).distinct()
    kept = keyed.join(lost, (doc == F.col(gone)) & (F.col(rid) == F.col(f"{gone}_rid")), "left_anti")
    if not found.where("first").groupBy("doc_id", "rid").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", rid]).unionByName(kept.where("doc_id is null"))
    return kept.drop(rid)
