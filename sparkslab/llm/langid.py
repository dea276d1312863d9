"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point).  An
n-gram's vector binds its letters' vectors, each rotated by its place, with an
elementwise product.  A document's vector bundles (sums) its n-gram vectors, a
language's prototype bundles all n-grams of its training documents, and a
document gets the language of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
N = 3
SEED = 20_240_229
#: n-gram vectors a worker keeps; when full, the table starts anew.
CACHE_GRAMS = 40_000
#: Documents bundled at once, and the n-grams of theirs taken at once.
BUNDLED = 64
GRAMS_AT_ONCE = 8_192
UNDETERMINED = "und"
_SPACE = 32
_BITS = 21  # of a code point

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text (packed code points) and their counts; none if it has no letter.

    Letters are lower-cased; any run of other characters counts as one blank,
    and a blank stands before the first and after the last letter.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter()[cp]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(letter, cp, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = cp[keep]
    cp = np.concatenate([[_SPACE] * int(cp[0] != _SPACE), cp, [_SPACE] * int(cp[-1] != _SPACE)]).astype(np.int64)
    return np.unique((cp[:-2] << 2 * _BITS) | (cp[1:-1] << _BITS) | cp[2:], return_counts=True)


class GramVectors:
    """n-gram vectors, made on demand."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros((0, dimensions), np.float32)

    def _letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            bits = np.random.default_rng([self.seed, cp]).integers(0, 2, self.dimensions)
            self.letters[cp] = (2 * bits - 1).astype(np.float32)
        return self.letters[cp]

    def _make(self, code: int) -> np.ndarray:
        mask = (1 << _BITS) - 1
        out = np.ones(self.dimensions, np.float32)
        for place in range(N):
            out *= np.roll(self._letter((code >> place * _BITS) & mask), place)
        return out

    def learn(self, codes: np.ndarray) -> None:
        """Have all of ``codes`` at hand."""
        fresh = np.setdiff1d(codes, self.codes)
        if not len(fresh):
            return
        if len(self.codes) + len(fresh) > CACHE_GRAMS:
            fresh = np.unique(codes)
            self.codes, self.rows = fresh[:0], self.rows[:0]
        made = np.stack([self._make(int(c)) for c in fresh])
        both = np.concatenate([self.codes, fresh])
        order = np.argsort(both)
        self.codes, self.rows = both[order], np.concatenate([self.rows, made])[order]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors, each as often as counted."""
        out = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(codes), CACHE_GRAMS // 2):
            some = codes[i : i + CACHE_GRAMS // 2]
            self.learn(some)
            out += counts[i : i + CACHE_GRAMS // 2].astype(np.float32) @ self.rows[np.searchsorted(self.codes, some)]
        return out


    def bundles(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each document's bundle: their n-grams' counts, as a matrix, times the n-grams' vectors."""
        codes, at = np.unique(np.concatenate([g for g, _ in docs]), return_inverse=True)
        of = np.repeat(np.arange(len(docs)), [len(g) for g, _ in docs])
        counts = np.concatenate([c for _, c in docs]).astype(np.float32)
        out = np.zeros((len(docs), self.dimensions), np.float32)
        for i in range(0, len(codes), GRAMS_AT_ONCE):
            some = codes[i : i + GRAMS_AT_ONCE]
            self.learn(some)
            mine = (at >= i) & (at < i + GRAMS_AT_ONCE)
            matrix = np.zeros((len(docs), len(some)), np.float32)
            matrix[of[mine], at[mine] - i] = counts[mine]
            out += matrix @ self.rows[np.searchsorted(self.codes, some)]
        return out


_vectors: dict[tuple[int, int], GramVectors] = {}


def _shared(dimensions: int, seed: int) -> GramVectors:
    return _vectors.setdefault((dimensions, seed), GramVectors(dimensions, seed))


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of each non-null ``lang`` from all rows' whole ``text``.

    Each task bundles what it has seen of a language, and the bundles are
    summed; only (languages x dimensions) numbers reach the driver.  Rows
    without a letter add nothing; a language without any has no prototype.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _shared(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                by: dict[str, list] = {}
                for text, lang in zip(batch.column(0).slice(i, 500).to_pylist(), batch.column(1).slice(i, 500).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(grams(text))
                for lang, found in by.items():
                    codes, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    if len(codes):
                        counts = np.bincount(at, np.concatenate([c for _, c in found]))
                        sums[lang] = sums.get(lang, 0) + vectors.bundle(codes, counts).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    parts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null").mapInArrow(run, "lang string, i int, v double")
    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).collect():
        v = np.array([x.v for x in row.v])
        if np.linalg.norm(v) > 0:
            out[row.lang] = v / np.linalg.norm(v)
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the nearest prototype of each whole text and its cosine, cut to 0..1.

    ``docs`` has doc_id, text and held_out.  A null text or one without letters
    is ``und`` with score 0, and so is every text when there is no prototype.
    Ties go to the language that sorts first; repeated rows give repeated
    results.
    """
    names = list(prototypes)
    against = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _shared(dimensions, seed)
        for batch in batches:
            langs, scores = [], []
            for i in range(0, batch.num_rows, BUNDLED):
                some = [grams(t or "") for t in batch.column(2).slice(i, BUNDLED).to_pylist()]
                bundled = vectors.bundles(some) if names else []
                for k, (codes, _) in enumerate(some):
                    best, score = UNDETERMINED, 0.0
                    if len(codes) and names:
                        cosine = against @ bundled[k] / max(float(np.linalg.norm(bundled[k])), 1e-12)
                        top = int(cosine.argmax())
                        best, score = names[top], float(min(max(cosine[top], 0.0), 1.0))
                    langs.append(best)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("held_out").cast("boolean"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fold(of: str | Column, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(of).cast("string") if isinstance(of, str) else of) % folds


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Learn from the documents outside fold 2 of 4 and predict every document."""
    marked = docs.withColumn("held_out", F.coalesce(fold(docs["doc_id"].cast("string"), 4) == 2, F.lit(False)))
    return predict(marked, learn_prototypes(marked.where("not held_out"), dimensions, seed), dimensions, seed)
