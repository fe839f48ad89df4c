"""Token ids in a content-addressed store: chunks cut by rolling hashes, recipes, Merkle manifests.

Layout of a store, all Parquet:

* ``chunks``: ``hash`` (blake2b-128 of the ids as little-endian 32-bit
  integers), ``payload`` (ids in 16 bits where ``wide`` is false, else 32,
  compressed with zstandard); each distinct chunk once.
* ``recipes``: ``part, doc_id, start, n_tokens, hashes, lengths, root``, one
  row a document in ascending doc_id order; ``root`` is the Merkle root over
  the chunk hashes.
* ``manifest``: for each part of the recipes, the Merkle root over its
  documents' roots, its first start, its tokens and documents.
* ``top``: one row, the Merkle root over all parts and their number.

A store that has lost or changed a chunk, a recipe or a row of the manifest
is refused: ``read`` and ``digests`` raise ``ValueError`` (``DamagedStore``)
or fail with its message.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import in_groups
from .bpe import encoder
from .shared import new_path, spread, written

#: A cut follows an id where the rolling hash of the last 16 ids has its low bits clear.
LOW_BITS, LEAST, MOST = 9, 128, 8192
_GEAR = np.random.default_rng(606).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
_CHARS = 1 << 22
_SEEN = 100_000
_ROW = "kind int, key long, doc_id long, n_tokens long, hashes array<binary>, lengths array<int>, root binary, hash binary, wide boolean, payload binary"


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4").data, digest_size=16).digest()


def marks(ids: np.ndarray, low_bits: int = LOW_BITS) -> np.ndarray:
    """Where a chunk may end: after an id where the hash of the last 16 ids has its low bits clear."""
    h = _GEAR[ids & 0xFFFF] ^ ids.astype(np.uint64) >> np.uint64(16)
    for k in (1, 2, 4, 8):  # hashes of 2, 4, 8 and 16 ids
        h[k:] += h[:-k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(16)) & np.uint64((1 << low_bits) - 1) == 0) + 1


def ends(marks_: list[int], first: int, last: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one document, ids ``first`` to ``last`` of a stream, given the marks between.

    Marks fewer than ``least`` ids from the last end do not count, so what lies
    before a document in its stream has no effect on its chunks.
    """
    out, at = [], first
    for m in [*marks_, last]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or m == last > at:
            out.append(m)
            at = m
    return out


def cuts(ids: np.ndarray, low_bits: int = LOW_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of an id stream; they depend on nearby ids only, within ``least`` and ``most`` ids."""
    return ends(marks(ids, low_bits).tolist(), 0, len(ids), least, most)


def merkle(leaves: list[bytes]) -> bytes:
    """Root over hashes, in pairs; an odd last one rises unpaired."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cutter(path: str, end_id: int):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press, seen = encoder(path), zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in in_groups([len(t or "") for t in texts], _CHARS):
                ids, to = own.encode(texts[s:e])
                stream = np.insert(ids, to[1:], end_id).astype("<u4")
                to = to + np.arange(len(to))
                may = marks(stream)
                between = np.searchsorted(may, to).tolist()
                may, to = may.tolist(), to.tolist()
                rows = []
                for k, doc_id in enumerate(doc_ids[s:e]):
                    hashes, lengths, at = [], [], to[k]
                    for stop in ends(may[between[k] : between[k + 1]], at, to[k + 1]):
                        part = stream[at:stop]
                        name = hashlib.blake2b(part.data, digest_size=16).digest()
                        hashes.append(name)
                        lengths.append(stop - at)
                        at = stop
                        if name not in seen:
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(name)
                            wide = bool(part.max() > 0xFFFF)
                            rows.append((0, int.from_bytes(name[:8], "little", signed=True), None, None, None, None, None, name, wide, press.compress(part.data if wide else part.astype("<u2").data)))
                    root = merkle(hashes)
                    rows.append((1, int.from_bytes(root[:8], "little", signed=True) ^ (doc_id or 0), doc_id, to[k + 1] - to[k], hashes, lengths, root, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _ROW.split(", ")])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the first of each chunk, and every recipe."""
    last = None
    for batch in batches:
        keep = []
        for name in batch.column(7).to_pylist():
            keep.append(name is None or name != last)
            last = name
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each followed by ``end_id``, as a store at ``path``.

    Null texts are empty: their ids are the end id alone. Rows order by
    doc_id (null first), equal ones by their content; repeated rows are
    separate documents that share chunks. An empty table gives an empty store.
    Each task sends a chunk once, so a chunk that a third of all documents
    share arrives once from each task; recipes carry hashes only.
    """
    spark, n = docs.sparkSession, spread(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = f"{path}/raw"
    rows = docs.mapInArrow(_cutter(tokenizer, end_id), _ROW).repartition(n, "key").sortWithinPartitions("kind", "hash")
    rows.mapInArrow(_once, _ROW).write.option("compression", "none").partitionBy("kind").parquet(raw)
    table = spark.read.schema(_ROW).parquet(raw)
    recipes = table.where("kind = 1").select("doc_id", "n_tokens", "hashes", "lengths", "root")
    ordered = recipes.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "recipes")
    totals = sorted((r["part"], r["tokens"]) for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).collect())  # a row for each part
    offsets, at = [], 0
    for part, tokens in totals:
        offsets.append((part, at))
        at += tokens
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1))
    base = spark.createDataFrame(offsets, "part int, base long")
    final = ordered.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.coalesce(before, F.lit(0))).drop("base")
    final.sortWithinPartitions("part", "start").select("part", "doc_id", "start", "n_tokens", "hashes", "lengths", "root").write.parquet(f"{path}/recipes")

    _parts(spark, path, n).write.parquet(f"{path}/manifest")
    found = spark.read.parquet(f"{path}/manifest").collect()  # a row for each part
    spark.createDataFrame([(_top(found), len(found))], "root binary, parts long").coalesce(1).write.parquet(f"{path}/top")


def _parts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``part, root, first, tokens, documents`` of each part of the recipes as they are; starts that do not follow one another stop it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roots, first, tokens = None, [], 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([merkle(roots)], pa.binary()), *(pa.array([x], pa.int64()) for x in (first, tokens, len(roots)))], ["part", "root", "first", "tokens", "documents"])

        for batch in batches:
            for p, root, k, start in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if p != part:
                    if roots:
                        yield close()
                    part, roots, first, tokens = p, [], start, 0
                if start != first + tokens:
                    raise DamagedStore(f"part {p}: a document begins at {start}, not at {first + tokens}")
                roots.append(root)
                tokens += k
        if roots:
            yield close()

    kept = recipes(spark, path).select("part", "root", "n_tokens", "start")
    return kept.repartition(n, "part").sortWithinPartitions("part", "start").mapInArrow(run, "part int, root binary, first long, tokens long, documents long")


def _top(parts: list) -> bytes:
    return merkle([hashlib.blake2b(repr(tuple(r)).encode(), digest_size=16).digest() for r in sorted(parts, key=lambda r: r["part"])])


def verify(spark: SparkSession, path: str) -> None:
    """Hold the recipes against the manifest, and that against the store's root; raises ``DamagedStore`` where they differ.

    One row for each part comes to the driver.
    """
    manifest = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r["part"])
    top = spark.read.parquet(f"{path}/top").collect()
    if len(top) != 1 or top[0]["parts"] != len(manifest) or bytes(top[0]["root"]) != _top(manifest):
        raise DamagedStore("the manifest does not match the root of the store")
    found = sorted(_parts(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions"))).collect(), key=lambda r: r["part"])
    if [tuple(r) for r in found] != [tuple(r) for r in manifest]:
        raise DamagedStore(f"recipes of parts {sorted(set(map(tuple, found)) ^ set(map(tuple, manifest)))[:3]} do not match the manifest")


class DamagedStore(ValueError):
    """What a store holds is not what its addresses, roots or manifest say."""


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(f"{path}/raw").where("kind = 0").select("hash", "wide", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def _open(name: bytes, wide: bool, payload: bytes, press) -> np.ndarray:
    ids = np.frombuffer(press.decompress(payload), "<u4" if wide else "<u2").astype("<u4")
    if address(ids) != bytes(name):
        raise DamagedStore(f"chunk {name.hex()} does not hold what its address says")
    return ids


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over recipes: a row for each chunk, with its place and the ids after it; a recipe that contradicts itself stops the read."""
    for batch in batches:
        doc_id, start, place, name, size, after = [], [], [], [], [], []
        for d, s, hashes, lengths, root, n_tokens in zip(*(batch.column(c).to_pylist() for c in range(6))):
            rest = sum(lengths)
            if merkle(hashes) != root or len(hashes) != len(lengths) or rest != n_tokens:
                raise DamagedStore(f"the recipe of document {d} does not match its root or its number of ids")
            for k, (h, n) in enumerate(zip(hashes, lengths)):
                rest -= n
                doc_id.append(d)
                start.append(s)
                place.append(k)
                name.append(h)
                size.append(n)
                after.append(rest)
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(place, pa.int32()), pa.array(name, pa.binary()), pa.array(size, pa.int64()), pa.array(after, pa.int64())], ["doc_id", "start", "k", "hash", "size", "after"])


def _joined(spark: SparkSession, path: str, bodies: DataFrame, *columns: str) -> DataFrame:
    """Chunks of all recipes with ``columns`` of ``bodies`` (hash, n, ..); a chunk that is missing or of another length stops the read."""
    verify(spark, path)
    parts = recipes(spark, path).select("doc_id", "start", "hashes", "lengths", "root", "n_tokens").mapInArrow(_leaves, "doc_id long, start long, k int, hash binary, size long, after long")
    lost = F.raise_error(F.concat(F.lit("damaged store: chunk "), F.hex("hash"), F.when(F.col("n").isNull(), " is missing").otherwise(" has another length")))
    whole = F.when(F.col("n").eqNullSafe(F.col("size")), F.col("n")).otherwise(lost.cast("long"))
    return parts.join(bodies, "hash", "left").select("doc_id", "start", "k", whole.alias("n"), "after", *columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<long>``, rebuilt from the store, verified first and chunk by chunk."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [_open(*row, press).astype(np.int64) for row in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["hash", "n", "ids"])

    parts = _joined(spark, path, chunks(spark, path).mapInArrow(opened, "hash binary, n long, ids array<long>"), "ids")
    whole = parts.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "n", "ids"))).alias("parts"))  # chunks of one document
    return whole.select("doc_id", "start", F.flatten("parts.ids").alias("ids"))


def _shift_tables() -> np.ndarray:
    """For each k, a byte-wise table of the CRC-32 register after 4 * 2^k zero bytes."""

    def advance(rows: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= rows[i]
        return out

    one = [(0xEDB88320 if i == 0 else 1 << (i - 1)) for i in range(32)]  # one zero bit
    for _ in range(5):  # 32 bits
        one = [advance(one, one[i]) for i in range(32)]
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        for j in range(4):
            for v in range(256):
                tables[k, j, v] = advance(one, v << (8 * j))
        one = [advance(one, one[i]) for i in range(32)]
    return tables


_tables: list[np.ndarray] = []


def shifted(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer stream with so many 32-bit words after it."""
    if not _tables:
        _tables.append(_shift_tables())
    crc = crc.astype(np.uint32)
    for k in range(40):
        on = (words >> k) & 1 == 1
        if on.any():
            x = crc[on]
            t = _tables[0][k]
            crc[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return crc


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    Each stored chunk is opened and checked once; a document's CRC-32 is that
    of its chunks, each shifted by the ids after it, so no payload is shuffled.
    The store is verified first: manifest, recipes, and every chunk they name.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [_open(*row, press) for row in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.data) for x in found], pa.int64())], ["hash", "n", "crc"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shifted(crc, after).astype(np.int64))], ["doc_id", "start", "n", "crc"])

    bodies = chunks(spark, path).mapInArrow(measured, "hash binary, n long, crc long")
    found = _joined(spark, path, bodies, "crc").select("doc_id", "start", "n", "crc", "after")
    found = found.mapInArrow(moved, "doc_id long, start long, n long, crc long")
    return found.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"))


def stored(docs: DataFrame, tokenizer: str, end_id: int = 0) -> str:
    """Write a store in the shared folder; returns its path."""
    path = new_path(docs.sparkSession, "store")
    write(docs, path, tokenizer, end_id)
    return path
