"""Media columns: payloads as content-defined chunks, each distinct chunk stored once.

A payload is cut where a rolling gear hash of the last bytes meets a mask, so
equal passages give equal chunks wherever they stand.  Chunks go by their
SHA-256 digests.  Equal payloads are one object; among the objects, a join on
digests finds each repeated chunk's owner, and only the owner's row keeps its
bytes.  The stored form of a payload is its chunk list: the whole's digest, and
each chunk's length and digest in order.  It is written beside the chunks and
read back; the object is rebuilt from it, with other owners' chunks fetched by
digest, and every chunk and the whole are verified.

Payload bytes cross the network compressed and once; lists of digests are what
is joined.  A chunk that many objects want is copied for each ``SPREAD`` of
them, so that no task serves them all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

#: A payload is padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 576, b"\xff"
#: Smallest and largest chunk, and the bits that must be zero at a cut.
LEAST, MOST, CUT_BITS = 256, 16_384, 10
_WINDOW = 16
_GEAR = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)
LEVEL = 15
#: Texts that the compression dictionary is made from, about, the bytes taken of each, and the dictionary's; few texts make none.
DICTIONARY_TEXTS, DICTIONARY_TEXT_BYTES, DICTIONARY_BYTES = 2_000, 65_536, 262_144
#: Bytes of a digest by which chunks and objects are joined and chunks verified; wholes are verified by all of theirs.
KEY = 16
#: Objects that one copy of a shared chunk serves, about.
SPREAD = 4_096

SHARE = "array<struct<i:int,copies:int>>"
OBJECT = f"key binary, manifest binary, others {SHARE}, wanted {SHARE}, blob binary"


def payload(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded; null is empty."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def gear(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: the last 16 bytes' gear values, each shifted by its age."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < _WINDOW:
        late = h.copy()
        late[step:] += h[:-step] << np.uint32(step)
        h, step = late, 2 * step
    return h


def chunk_lengths(data: bytes) -> list[int]:
    """Lengths of the chunks of non-empty ``data``, in order."""
    cuts = np.flatnonzero((gear(data) & np.uint32(((1 << CUT_BITS) - 1) << 5)) == 0) + 1
    out, at, k, cuts = [], 0, 0, cuts.tolist()
    while len(data) - at > LEAST:
        while k < len(cuts) and cuts[k] < at + LEAST:
            k += 1
        end = min(cuts[k] if k < len(cuts) else len(data), at + MOST, len(data))
        out.append(end - at)
        at = end
    if at < len(data):
        out.append(len(data) - at)
    return out


def chunks(data: bytes) -> list[bytes]:
    """The chunks themselves."""
    out, at = [], 0
    for n in chunk_lengths(data):
        out.append(data[at : at + n])
        at += n
    return out


def digest(chunk: bytes) -> bytes:
    """What a chunk goes by."""
    return hashlib.sha256(chunk).digest()[:KEY]


def pack_list(sha: bytes, lens: list[int], digests: list[bytes]) -> bytes:
    """The stored form: a mark, the whole's digest, the chunks' number, their lengths, their digests."""
    return b"CDC2" + sha + struct.pack(f"<I{len(lens)}I", len(lens), *lens) + b"".join(digests)


def unpack_list(stored: bytes) -> tuple[bytes, list[int], list[bytes]]:
    """(sha, lens, digests) of a stored form."""
    if stored[:4] != b"CDC2":
        raise ValueError("not a chunk list")
    (n,) = struct.unpack_from("<I", stored, 36)
    at = 40 + 4 * n
    if len(stored) != at + KEY * n:
        raise ValueError("a chunk list of the wrong length")
    return stored[4:36], list(struct.unpack_from(f"<{n}I", stored, 40)), [stored[at + KEY * i : at + KEY * (i + 1)] for i in range(n)]


def feature(data: bytes) -> str:
    """Mean, deviation and entropy (bits) of the 8-bit samples, and the share of sign changes about 128."""
    x = np.frombuffer(data, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    some = p[p > 0]
    entropy = float(-(some * np.log2(some)).sum())
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};crossings={crossings}"


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, lists = [], [], []
        for text in batch.column(1):
            t = text.as_py()
            data = payload(t)
            keys.append(digest(data))
            sizes.append(len((t or "").encode("utf-8", "replace")))
            lists.append([digest(c) for c in chunks(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "key", "digests"])


class Codec:
    """Compression with a dictionary, which is kept with the store."""

    def __init__(self, dictionary: bytes = b"") -> None:
        self.dictionary = dictionary
        self._pair = None

    def __getstate__(self) -> bytes:
        return self.dictionary

    def __setstate__(self, dictionary: bytes) -> None:
        self.dictionary, self._pair = dictionary, None

    def _both(self):
        if self._pair is None:
            d = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
            self._pair = zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)
        return self._pair

    def compress(self, data: bytes) -> bytes:
        """One frame."""
        return self._both()[0].compress(data)

    def decompress(self, frame: bytes) -> bytes:
        """Its contents."""
        return self._both()[1].decompress(frame)


def codec_for(docs: DataFrame) -> Codec:
    """A codec with a dictionary made from a bounded sample of the texts, chosen and ordered by their hashes.

    It only makes the stored bytes smaller.  Null texts are left out; too few
    texts make no dictionary.
    """
    n = docs.count()
    h = F.xxhash64("text")
    sample = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    if n > DICTIONARY_TEXTS:
        sample = sample.where(F.pmod(h, F.lit(1_000_003)) < int(1_000_003 * DICTIONARY_TEXTS / n))
    some = sample.select(F.substring("text", 1, DICTIONARY_TEXT_BYTES).alias("text"), h.alias("h")).distinct().orderBy("h", "text").limit(2 * DICTIONARY_TEXTS)
    texts = [r.text.encode("utf-8", "replace")[:DICTIONARY_TEXT_BYTES] for r in some.collect()]
    try:
        return Codec(zstandard.train_dictionary(DICTIONARY_BYTES, sorted(texts)).as_bytes())
    except zstandard.ZstdError:  # too few texts
        return Codec()


def _packed(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed payloads; of equal ones in a task's batch one."""
    for batch in batches:
        found = {}
        for text in batch.column(0):
            data = payload(text.as_py())
            key = digest(data)
            if key not in found:
                found[key] = codec.compress(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["key", "z"])


_SHARE = pa.list_(pa.struct([("i", pa.int32()), ("copies", pa.int32())]))


def _objects(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store: what an object owns stays, what another owns goes."""
    for batch in batches:
        for row in batch.to_pylist():
            data = codec.decompress(row["z"])
            parts = chunks(data)
            other = {x["i"] for x in row["others"] or ()}
            stored = pack_list(hashlib.sha256(data).digest(), [len(c) for c in parts], [digest(c) for c in parts])
            blob = codec.compress(b"".join(c for i, c in enumerate(parts) if i not in other)) if other else row["z"]
            values = [pa.array([row["key"]], pa.binary()), pa.array([stored], pa.binary()), pa.array([row["others"] or []], _SHARE), pa.array([row["wanted"] or []], _SHARE), pa.array([blob], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=["key", "manifest", "others", "wanted", "blob"])


def _own_chunks(row: dict, lens: list[int], codec: Codec) -> dict[int, bytes]:
    data, at, out = codec.decompress(row["blob"]), 0, {}
    other = {x["i"] for x in row["others"]}
    for i, n in enumerate(lens):
        if i not in other:
            out[i] = data[at : at + n]
            at += n
    return out


def _offered(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, copy, bytes) of owned chunks that other objects want, compressed."""
    for batch in batches:
        for row in batch.to_pylist():
            _, lens, digests = unpack_list(row["manifest"])
            own = _own_chunks(row, lens, codec)
            for x in row["wanted"]:
                z = codec.compress(own[x["i"]])
                n = x["copies"]
                yield pa.RecordBatch.from_arrays([pa.array([digests[x["i"]]] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([z] * n, pa.binary())], names=["digest", "copy", "z"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, i, digest, copy) of the chunks that an object has elsewhere."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            digests = unpack_list(row["manifest"])[2]
            rows += [(row["key"], x["i"], digests[x["i"]], int.from_bytes(row["key"][:8], "little") % x["copies"]) for x in row["others"]]
        types = [pa.binary(), pa.int32(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "i", "digest", "copy"])


def _rebuilt(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified payloads' digests and features, and those of the stored forms as they were read."""
    names = ["key", "payload_bytes", "payload_sha", "tail_crc32", "media_bytes", "media_sha", "feature"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            sha, lens, digests = unpack_list(row["manifest"])
            parts = _own_chunks(row, lens, codec)
            parts.update({x["i"]: codec.decompress(x["z"]) for x in row["fetched"] or ()})
            for i, d in enumerate(digests):
                if digest(parts[i]) != d:
                    raise ValueError(f"chunk {i} of {sha.hex()} is damaged")
            data = b"".join(parts[i] for i in range(len(lens)))
            if hashlib.sha256(data).digest() != sha:
                raise ValueError(f"object {sha.hex()} is damaged")
            rows.append((row["key"], len(data), sha, zlib.crc32(data[-32:]), len(row["manifest"]), hashlib.sha256(row["manifest"]).digest(), feature(data)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def store(docs: DataFrame, codec: Codec) -> tuple[DataFrame, DataFrame]:
    """(names, objects): each document's object, and the chunk store, both written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = stage(rows.mapInArrow(_digest_lists, "doc_id long, n_bytes long, key binary, digests array<binary>"), "media-lists")
    places = lists.select("key", "digests").dropDuplicates(["key"]).select("key", F.posexplode("digests").alias("i", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("key", "i")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    shared = places.join(owners, "digest").withColumn("mine", (F.col("key") == F.col("owner.key")) & (F.col("i") == F.col("owner.i")))
    share = F.struct("i", F.ceil(F.col("n") / SPREAD).cast("int").alias("copies"))
    marks = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.when(~F.col("mine"), share))).alias("others"), F.sort_array(F.collect_list(F.when(F.col("mine"), share))).alias("wanted"))
    packed = rows.select("text").mapInArrow(lambda it: _packed(codec, it), "key binary, z binary")
    none = F.lit(None).cast(SHARE)
    both = packed.select("key", "z", none.alias("others"), none.alias("wanted")).union(marks.select("key", F.lit(None).cast("binary").alias("z"), "others", "wanted"))
    joined = both.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("z", "others", "wanted")])
    # blobs are compressed already
    return lists.select("doc_id", "n_bytes", "key"), stage(joined.mapInArrow(lambda it: _objects(codec, it), OBJECT), "media-objects", codec="none")


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests and a feature of every document, from the stored bytes.

    Null and empty texts are one unit of padding; equal texts have equal values;
    repeated rows give repeated results; a null id is carried.  A chunk or an
    object whose digest differs stops the query.  media_bytes and media_sha256
    are of the stored form, the chunk list, as it is read.
    """
    codec = codec_for(docs)
    spark = docs.sparkSession
    stage(spark.createDataFrame([(bytearray(codec.dictionary),)], "dictionary binary"), "media-dictionary")
    names, objects = store(docs, codec)
    whole = F.size("others") == 0
    offered = objects.where(F.size("wanted") > 0).mapInArrow(lambda it: _offered(codec, it), "digest binary, copy int, z binary")
    needs = objects.where(~whole).select("key", "manifest", "others").mapInArrow(_needs, "key binary, i int, digest binary, copy int")
    fetched = needs.join(offered, ["digest", "copy"]).groupBy("key").agg(F.collect_list(F.struct("i", "z")).alias("fetched"))
    parted = objects.where(~whole).join(fetched, "key", "left")
    alone = objects.where(whole).withColumn("fetched", F.lit(None).cast(parted.schema["fetched"].dataType))
    columns = ["key", "manifest", "others", "blob", "fetched"]
    made = alone.select(columns).union(parted.select(columns)).mapInArrow(lambda it: _rebuilt(codec, it), "key binary, payload_bytes long, payload_sha binary, tail_crc32 long, media_bytes long, media_sha binary, feature string")
    text = lambda c: F.lower(F.hex(c)).alias(f"{c}256")
    return names.join(made, "key").select("doc_id", "n_bytes", "payload_bytes", text("payload_sha"), "tail_crc32", "media_bytes", text("media_sha"), "feature")
