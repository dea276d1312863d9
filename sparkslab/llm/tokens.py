"""Token-ID output in Simple-8b shards, in ascending document order.

A shard is what one range of document ids gives, written in segments.  A
segment is one row of a Parquet table (Parquet is only the container that
commits atomically on any file system): ``words`` is the Simple-8b stream,
``offsets`` has each 512-id block's first word, so any block can be decoded by
itself, and ``doc_ids``/``doc_tokens`` say which ids belong to which document.
``base`` is the number of ids before the segment in its shard.

Shards are numbered by range partition, so ascending (shard, segment) is
ascending ``doc_id``; a document's start follows from the shards' totals, of
which there is one row a shard.  A task that is lost is run again and commits
once.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkslab.llm import simple8b
from sparkslab.plans.stage import new_path

#: Ids after which a segment is closed (a document is never divided).
SEGMENT_IDS = 1 << 19
#: Words kept by a worker with their ids, in each of two generations.
CACHE_WORDS = 500_000
#: Longer pieces are encoded each time.
CACHE_CHARS = 48

SEGMENT = "shard long, segment long, base long, n_ids long, doc_ids array<long>, doc_tokens array<long>, offsets binary, words binary"
DECODED = "doc_id long, shard long, start_in_shard long, n_tokens long, ids_crc32 long"


# The normaliser and splitter under which a text may be encoded piece by piece (see ``Encoder``).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_blanks(tokenizer) -> bool:
    """Whether a tokenizer is known to drop white space and to start anew behind it, on lower-case text.

    Its normaliser, its splitter and its special tokens are compared with the
    ones for which that was established; any other tokenizer gets whole texts.
    """
    spec = json.loads(tokenizer.to_str())
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    known = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    special = all("<" in t["content"] and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return known and special and spec["truncation"] is None and spec["padding"] is None and spec["post_processor"] is None


#: ASCII marks but the apostrophe, what stands between them, and marks again.
_MARKED = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^!-/:-@\[-`{-~](?:.*[^!-/:-@\[-`{-~])?)([!-&(-/:-@\[-`{-~]*)", re.S).fullmatch
#: Letters of the Latin blocks, of which those that normalisation leaves alone but for their case are merged directly.
_LATIN = [chr(i) for i in range(0x41, 0x250) if chr(i).isalpha()]


class Encoder(dict):
    """Encodes whole texts, and is the table of the ids of their pieces between blanks.

    Where white space always ends a token (``splits_at_blanks``), a text's ids
    are those of its pieces, and a piece that occurs again needs no new merge.
    Marks before or after a word of plain Latin letters are tokens of their own
    (but for an apostrophe, and where a special token may stand).  A word of
    such letters only is one input of the library's merges, as it normalises and
    maps each letter; all else goes through the library as it stands.  When the
    table is full, pieces not asked for since it was half full go.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_at_blanks(self.tokenizer)
        self.older: dict[str, bytes] = {}
        self.plain = {}
        if self.by_piece:
            for c in _LATIN:
                low = self.tokenizer.normalizer.normalize_str(c)
                mapped = self.tokenizer.pre_tokenizer.pre_tokenize_str(low)
                if unicodedata.normalize("NFC", c) == c and len(low) == 1 and low.isalpha() and len(mapped) == 1:
                    self.plain[ord(c)] = mapped[0][0]
            letters = "".join(map(chr, self.plain))
            self.word = re.compile(f"[{letters}]+").fullmatch
            self.merges = self.tokenizer.model.tokenize

    def _merge(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _new(self, piece: str) -> bytes:
        if self.word(piece):
            return array("I", [t.id for t in self.merges(piece.translate(self.plain))]).tobytes()
        if piece and "<" not in piece and (m := _MARKED(piece)) and (m[1] or m[3]) and self.word(m[2][0]) and self.word(m[2][-1]):
            return (self[m[1]] if m[1] else b"") + self[m[2]] + (self[m[3]] if m[3] else b"")
        return self._merge(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian 32-bit integers; null is empty."""
        if not self.by_piece:
            return self._merge(text or "")
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        segment = base = held = 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), dtype="<u4")
            words, offsets = simple8b.encode(values)
            row = [[shard], [segment], [base], [len(values)], [doc_ids], [sizes], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "segment", "base", "n_ids", "doc_ids", "doc_tokens", "offsets", "words"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1), strict=True):
                got = encoder.encode(text.as_py())
                ids += (got, end)
                doc_ids.append(key)
                sizes.append(len(got) // 4 + 1)
                held += sizes[-1]
                if held >= SEGMENT_IDS:
                    yield close()
                    base, segment, held = base + held, segment + 1, 0
                    ids, doc_ids, sizes = [], [], []
        if sizes:
            yield close()

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id long, text string) into the shard table at ``out``.

    Every document gets ``end_id`` appended.  Null texts are empty; rows of one
    doc_id are ordered by text; a null doc_id comes first.  Other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ranged.mapInArrow(_segments(tokenizer_path, end_id), SEGMENT).write.option("compression", "zstd").parquet(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = segment_ids(row["words"], row["offsets"], row["n_ids"]).tobytes()
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array(starts + row["base"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"],
            )


def segment_ids(words: bytes, offsets: bytes, n_ids: int) -> np.ndarray:
    """A segment's ids as little-endian 32-bit integers."""
    return simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4").astype(np.int64), n_ids).astype("<u4")


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard table, decoded from it."""
    shards = spark.read.schema(SEGMENT).parquet(path)
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # one row for each range partition: as many as the writing stage had tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    found = shards.mapInArrow(_decode, DECODED)
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write the shard table (to ``out``, else in the shared folder) and return what is read back from it.

    An empty table gives an empty result; an empty or null text gives the end
    id alone; repeated rows are repeated documents, one after the other.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    write_shards(docs, tokenizer_path, out, end_id)
    return read_digests(spark, out)
