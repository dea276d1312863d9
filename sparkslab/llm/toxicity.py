"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their first three,
four and five letters, each hashed to 64 bits.  The terms whose share of toxic
documents differs clearly from the average get a weight and a factor vector.
So do those that say nothing alone but much beside one of these: weights alone
are fitted first, and a term joins if, beside one particular chosen term, what
the weights leave unexplained is clearly not zero.  The machine adds the weights
of the terms present and the inner products of all their pairs, so that two
terms can count together for more (or less) than apart.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.llm.langid import fold
from sparkslab.plans.stage import stage

#: Labelled rows to learn from, about: beyond that a hash of the id thins them out.
MAX_LABELLED = 20_000
#: Documents that a term must be in, and standard errors by which its toxic share must differ.
MIN_DOCS = 3
MIN_Z = 5.0
#: Variance of a label, given the weights, from which a row tells about pairs.
UNSURE = 0.01
#: Terms, and pairs of them, that are worked on at once.
BLOCK = 400_000
FACTORS = 8
STEPS = 200
RATE = 0.05
DECAY = 1e-4
SEED = 7
_PREFIXES = (3, 4, 5)
#: Stands for every row among the terms.
EVERY = 0
#: Words a worker keeps with their terms; when full, the table starts anew.
CACHE_WORDS = 400_000

_WORD = re.compile(r"\w+")


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) - (1 << 63)


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    return (_hash(word), *(_hash("^" + word[:n]) for n in _PREFIXES if len(word) >= n))


def words(text: str | None) -> set[str]:
    """The distinct words of a text; null has none."""
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """Bias, and for each term's hash (sorted) a weight and a factor vector."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of documents given by the places of their terms in ``terms``."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        out = np.full(len(docs), self.bias)
        some = np.flatnonzero(sizes)
        if len(some):
            at = np.concatenate([docs[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            v = self.factors[at]
            total = np.add.reduceat(v, starts)
            pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            out[some] += np.add.reduceat(self.weights[at], starts) + pairs
        return out


class _Block:
    """Rows, as places in the parameters, that are worked on at once."""

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        self.y, self.weight = y, weight
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.some = np.flatnonzero(sizes)
        self.at = np.concatenate([docs[i] for i in self.some]) if len(self.some) else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(self.some)), sizes[self.some])
        self.starts = np.concatenate([[0], np.cumsum(sizes[self.some])[:-1]]).astype(np.int64) if len(self.some) else self.at
        self.by_term = np.argsort(self.at, kind="stable")
        self.terms, self.term_starts = np.unique(self.at[self.by_term], return_index=True)

    def add_gradient(self, bias: float, w: np.ndarray, v: np.ndarray, grad_w: np.ndarray, grad_v: np.ndarray) -> float:
        """Adds to the gradients of the summed loss; returns the bias's."""
        logit = np.full(len(self.y), bias)
        if len(self.some):
            rows = v[self.at]
            total = np.add.reduceat(rows, self.starts)
            logit[self.some] += np.add.reduceat(w[self.at], self.starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((rows**2).sum(1), self.starts))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - self.y) * self.weight
        if len(self.some):
            e = error[self.some][self.of][self.by_term]
            grad_w[self.terms] += np.add.reduceat(e, self.term_starts)
            if v.shape[1]:
                grad_v[self.terms] += np.add.reduceat(e[:, None] * (total[self.of] - rows)[self.by_term], self.term_starts)
        return float(error.sum())


def _blocks(docs: list[np.ndarray], y: np.ndarray) -> list[_Block]:
    """Equal rows as one with their number as weight; blocks of about ``BLOCK`` terms."""
    counts: dict[tuple, int] = {}
    for d, t in zip(docs, y.tolist(), strict=True):
        key = (d.tobytes(), t)
        counts[key] = counts.get(key, 0) + 1
    out, rows, size = [], [], 0
    for (d, t), n in counts.items():
        rows.append((np.frombuffer(d, np.int64), t, n))
        size += len(rows[-1][0]) + 1
        if size >= BLOCK:
            out.append(rows)
            rows, size = [], 0
    return [_Block([r[0] for r in b], np.array([r[1] for r in b], float), np.array([r[2] for r in b], float)) for b in [*out, rows] if b]


def fit_machine(docs: list[np.ndarray], y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Machine:
    """Logistic loss with weight decay, by full-batch Adam; deterministic for given rows in given order.

    The gradient is summed over blocks of rows, so what it needs besides the
    parameters and the rows' places doesn't grow with them.
    """
    k, n = len(terms), max(len(y), 1)
    rng = np.random.default_rng(seed)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    theta = np.concatenate([[np.log(share / (1 - share))], np.zeros(k), rng.normal(0, 0.01, k * factors)])
    blocks = _blocks([np.asarray(d, np.int64) for d in docs], np.asarray(y, float))
    m, v2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if len(y) else 1):
        grad = np.zeros_like(theta)
        w, v = theta[1 : k + 1], theta[k + 1 :].reshape(k, factors)
        for b in blocks:
            grad[0] += b.add_gradient(theta[0], w, v, grad[1 : k + 1], grad[k + 1 :].reshape(k, factors))
        grad /= n
        grad[1:] += decay / n * theta[1:] * len(y) * 0.1
        m = 0.9 * m + 0.1 * grad
        v2 = 0.999 * v2 + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.999**step)) + 1e-8)
    return Machine(float(theta[0]), terms, theta[1 : k + 1].copy(), theta[k + 1 :].reshape(k, factors).copy())


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (term, documents, toxic documents) of a task's rows; EVERY stands for each of these rows."""
    for batch in batches:
        hashes, label = [], []
        for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = {h for w in words(text) for h in word_terms(w)}
            mine.add(EVERY)
            hashes.extend(mine)
            label.extend([t] * len(mine))
        if hashes:
            terms, at = np.unique(np.array(hashes, dtype=np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.bincount(at)), pa.array(np.bincount(at, np.array(label)).astype(np.int64))], names=["term", "n", "toxic"])


def _differing(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms whose toxic share differs from that of all rows."""
    counts = sample.mapInArrow(_term_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = stage(counts.where(F.col("n") >= MIN_DOCS), "toxicity-counts")
    every = counts.where(F.col("term") == EVERY).first()
    if every is None:
        return np.zeros(0, np.int64)
    share = min(max(every.toxic / every.n, 0.5 / every.n), 1 - 0.5 / every.n)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    return np.sort(np.array([r.term for r in counts.where(F.abs(z) >= MIN_Z).where(F.col("term") != EVERY).select("term").collect()], dtype=np.int64))


def _beside(sample: DataFrame, linear: Machine) -> np.ndarray:
    """Sorted hashes of the terms beside which, with one particular term of ``linear``, its residuals don't add up to about zero.

    Only rows count of which ``linear`` isn't sure, whatever their label: by
    ``UNSURE`` of variance.  A pair needs ``MIN_DOCS`` of them and a sum of
    ``MIN_Z`` standard errors.
    """
    share = 1 / (1 + np.exp(-np.clip(linear.bias, -30, 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(linear.terms)
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal held, size
            pairs, at = np.unique(np.concatenate([h[0] for h in held]), axis=0, return_inverse=True)
            n, e, v = (np.bincount(at.ravel(), np.concatenate([np.full(len(h[0]), h[i]) for h in held])) for i in (1, 2, 3))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n), pa.array(e), pa.array(v)], names=["c", "t", "n", "e", "v"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = lookup.places(text)
                if not len(at):
                    continue
                p = 1 / (1 + np.exp(-np.clip(linear.bias + linear.weights[at].sum(), -30, 30)))
                if p * (1 - p) < UNSURE:
                    continue
                mine = np.array(sorted({h for w in words(text) for h in word_terms(w)}), dtype=np.int64)
                for c in linear.terms[at]:
                    held.append((np.column_stack([np.full(len(mine), c), mine]), 1.0, y - p, p * (1 - p)))
                    size += len(mine)
                    if size >= BLOCK:
                        yield packed()
        if held:
            yield packed()

    if not len(linear.terms) or not 0 < share < 1:
        return np.zeros(0, np.int64)
    sums = sample.mapInArrow(run, "c long, t long, n double, e double, v double").groupBy("c", "t").agg(*[F.sum(x).alias(x) for x in "nev"])
    clear = sums.where((F.col("n") >= MIN_DOCS) & (F.abs("e") >= MIN_Z * F.sqrt("v"))).select("t").distinct()
    return np.sort(np.array([r.t for r in stage(clear, "toxicity-beside").collect()], dtype=np.int64))


class _Lookup:
    """From words to the places of their selected terms."""

    def __init__(self, terms: np.ndarray) -> None:
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> np.ndarray:
        known, found = self.known, set()
        for w in words(text):
            got = known.get(w)
            if got is None:
                got = tuple(self.place[t] for t in word_terms(w) if t in self.place)
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[w] = got
            if got:
                found.update(got)
        return np.array(sorted(found), dtype=np.int64)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit to ``labels`` (doc_id, toxic) on the whole texts of ``docs`` (doc_id, text).

    Rows with a null id or label are left out, repeated labels of a document
    count once (the larger wins), and so do copies of a text, which would make
    any of its terms look telling.  About ``max_labelled`` labels are used; that
    bound is why they can be broadcast, and why their terms can be gathered.
    Without labels every score is one half; without terms, the toxic share.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = given.count()
    if not n:
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if n > max_labelled:
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) < int(1_000_003 * max_labelled / n))
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(given), "doc_id").select("text", "toxic")
    sample = stage(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    if sample.isEmpty():
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    terms = _differing(sample)
    rows, y = _placed(sample, terms)
    more = _beside(sample, fit_machine(rows, y, terms, factors=0))
    if len(np.setdiff1d(more, terms)):
        terms = np.union1d(terms, more)
        rows, y = _placed(sample, terms)
    return fit_machine(rows, y, terms)


def _placed(sample: DataFrame, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows' places of ``terms`` and their labels, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(terms)
        for batch in batches:
            at = [lookup.places(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in at], pa.list_(pa.int32())), batch.column(1)], names=["at", "toxic"])

    rows = sorted((r.at, r.toxic) for r in sample.mapInArrow(run, "at array<int>, toxic int").collect())
    return [np.array(at, dtype=np.int64) for at, _ in rows], np.array([t for _, t in rows], dtype=float)


def score(docs: DataFrame, machine: Machine, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted, or what ``names`` calls them: every row, its whole text (null: empty), no shuffle.

    Other columns pass through; columns of these two names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(machine.terms)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            logits = machine.logits([lookup.places(t) for t in batch.column(i).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names])

    rows = docs.drop(*names)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, `{names[0]}` double, `{names[1]}` int")


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows that the machine doesn't call toxic, with all their columns, of any name."""
    fresh = uuid.uuid4().hex
    return score(docs, machine, (f"score_{fresh}", f"predicted_{fresh}")).where(F.col(f"predicted_{fresh}") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def training_fold(labels: DataFrame) -> DataFrame:
    """The labels of documents outside fold 0 of 5."""
    return labels.where(F.coalesce(fold(labels["doc_id"].cast("string"), 5) != 0, F.lit(False)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned outside fold 0 of 5."""
    machine = learn(docs, training_fold(labels))
    held_out = F.coalesce(fold(docs["doc_id"].cast("string"), 5) == 0, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")), machine).drop("text")
