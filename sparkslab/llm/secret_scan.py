"""Secrets in texts: fixed patterns, and strings in a sensitive context that zstandard can't compress.

A candidate's novelty is what it adds to the compressed size of the text around
it, per byte of its own, where the compressor is primed with a dictionary of
the corpus's identifiers.  Words and names made of known parts add little;
random strings add about their own size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns: the kind, what it needs to be there at all, the pattern, and the group that must have so many characters.
_PATTERNS = (
    ("assign", ("passw", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+", re.ASCII), 0, 20),
    ("hex", (), re.compile(r"[0-9a-f]{24,}", re.ASCII), 0, 24),
)
#: Words that make the code points after them sensitive, and how many.
SENSITIVE = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "signature", "login")
CONTEXT = 64
#: A candidate: so many characters at least, with a letter and a digit among them.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}", re.ASCII)
_LETTER, _DIGIT = re.compile(r"[A-Za-z]", re.ASCII), re.compile(r"[0-9]", re.ASCII)
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
#: Compressed bytes that a candidate adds, per byte of its own, from which it is reported.
NOVELTY = 0.8
#: Code points before and after a candidate that are compressed with it.
AROUND = 128
LEVEL = 3
#: The dictionary: identifiers of so many characters, no digits, how many of them, and bytes.
TERM_LETTERS, TERMS, DICTIONARY_BYTES = (3, 40), 4096, 32_768
#: Distinct identifiers that a task counts before it hands them on.
_COUNTED = 300_000

#: A word with a digit is no identifier to learn: copies of a secret would prime the compressor with its parts.
_TERM = re.compile(r"\w+")
SPAN = "kind string, start long, `end` long, novelty double"


class Novelty:
    """Marginal compressed bytes against the surrounding text and a dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        primed = {}
        if len(dictionary) >= 8:
            primed = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
            primed["dict_data"].precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **primed)

    def of(self, text: str, start: int, end: int) -> float:
        """Of text[start:end], per byte; other copies of it nearby don't make it less new."""
        it = text[start:end]
        before, after = (x.replace(it, "").encode() for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        it = it.encode()
        return (len(self.packer.compress(before + it + after)) - len(self.packer.compress(before + after))) / len(it)


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place in KINDS, end, start of the secret itself) of the fixed patterns, sorted; leftmost, not overlapping by kind."""
    found, lower = [], text.lower()
    for k, (_, needs, pattern, group, least) in enumerate(_PATTERNS):
        if not needs or any(x in lower for x in needs):
            found += [(m.start(), k, m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def scan_text(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, novelty) by start, then kind, of one text; ends are exclusive."""
    if not text:
        return []
    base = pattern_spans(text)
    spans = [(start, k, end, novelty.of(text, secret, end)) for start, k, end, secret in base]
    lower = text.lower()
    if any(x in lower for x in SENSITIVE):
        # the end of the last sensitive word before each candidate, and what the patterns cover
        ends = [m.end() for m in _SENSITIVE.finditer(text)]
        taken, reach = [s[0] for s in base], []
        for s in base:
            reach.append(max(s[2], reach[-1] if reach else 0))
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            at, under = bisect_right(ends, start), bisect_right(taken, end - 1)
            if not at or start - ends[at - 1] > CONTEXT or under and reach[under - 1] > start:
                continue
            if _LETTER.search(text, start, end) and _DIGIT.search(text, start, end) and (new := novelty.of(text, start, end)) >= NOVELTY:
                spans.append((start, len(_PATTERNS), end, new))
    return [(KINDS[k], start, end, new) for start, k, end, new in sorted(spans)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (term, docs) of a task's texts."""
    seen: Counter[str] = Counter()

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "docs"])
        seen.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(w for w in set(_TERM.findall(text or "")) if TERM_LETTERS[0] <= len(w) <= TERM_LETTERS[1] and (w.isalpha() or w.replace("_", "").isalpha()))
            if len(seen) >= _COUNTED:
                yield packed()
    if seen:
        yield packed()


def identifiers(docs: DataFrame) -> bytes:
    """The dictionary of ``docs`` (text): the identifiers that most documents hold, the commonest last.

    Counts are over all whole texts.  ``TERMS`` bounds what is gathered.
    """
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    top = stage(counts.where("docs > 1").orderBy(F.desc("docs"), "term").limit(TERMS), "identifiers")
    kept, size = [], 0
    for row in sorted(top.collect(), key=lambda r: (-r.docs, r.term)):
        size += len(row.term.encode()) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(row.term)
    return "\n".join(reversed(kept)).encode()


def scan(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``docs`` with a column secrets: the spans (kind, start, end, novelty) of each whole text, in code points.

    A null text is empty.  Other columns pass through; one called secrets is
    replaced.  No shuffle but for the dictionary, which is made of ``docs``
    unless given.  A string that a pattern covers in part is not reported again.
    """
    if dictionary is None:
        dictionary = identifiers(docs)
    rows = docs.drop("secrets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in scan_text(t, novelty)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "secrets"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, secrets array<struct<kind: string, start: bigint, `end`: bigint, novelty: double>>")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def reports(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the SHA-256 of the patterns' spans, and all spans ``kind:start:end``, of every document."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), n("novel"))
