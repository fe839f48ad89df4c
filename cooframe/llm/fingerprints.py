"""Document fingerprints: a sketch of every shingle hash below a fixed fraction of the range.

Half of the range is kept, in 32 bits a hash, so that a text of a dozen
shingles still has some in common with any longer text that holds it: with n
shingles all of them lie above with a probability of 2^-n only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import in_groups, shingles
from .shared import spread

WIDTH, SCALE = 5, 2
_CHARS = 1 << 19
#: What a row counts for beside its characters, so that runs of empty texts are bounded too.
_ROW = 64


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Of sorted 64-bit hashes the first 32 bits of those below 2^64 / scale, each once; where none is, of the least one, so that equal texts keep equal prints.

    A least hash above the fraction is no member of any other sketch, so such a
    text is like its equals only.
    """
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    kept = high[: np.searchsorted(hashes, np.uint64((1 << 64) // scale - 1))]
    if not len(kept):
        return high[:1]
    return kept[np.append(True, kept[1:] != kept[:-1])]


def sketches(texts: list[str | None], width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    return [sketch(x, scale) for x in shingles(texts, width)]


def write(print_: np.ndarray) -> str:
    """A sketch as text: base64 of its sorted hashes as little-endian 32-bit integers."""
    return base64.b64encode(print_.astype("<u4").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents together: of one least hash above the fraction nothing is left beside a true sketch."""
    both = np.union1d(a, b)
    kept = both[both < (1 << 32) // scale]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if both are empty, 0 if one is."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return float(np.count_nonzero(b[at] == a)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``doc_id, n_chars, n_kept, fingerprint`` for every row of ``docs`` (doc_id, text); null texts are empty and have an empty print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s, e in in_groups([len(t) + _ROW for t in texts], _CHARS):
                prints = sketches(texts[s:e], width, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array([len(t) for t in texts[s:e]], pa.int64()), pa.array([len(p) for p in prints], pa.int64()), pa.array([write(p) for p in prints])], ["doc_id", "n_chars", "n_kept", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_kept long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """``part, own, doc_id, text`` in ascending doc_id within parts of consecutive documents.

    Each part ends with a copy (own = false) of the document that follows it,
    the last part with a copy of the first document of all. Parts are ranges
    between quantiles of doc_id; only their bounds, a number for each part, go
    to the driver. Rows without doc_id come first; texts order equal doc_ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, 2 * spread(docs))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)})
    part = F.lit(0)
    if bounds:
        # part = how many bounds are at most doc_id, by halving
        part = F.coalesce(_rank(F.col("doc_id"), bounds, 0), F.lit(0))
    cut = docs.withColumn("part", part)
    # the first row of a part is taken by (doc_id, text); ties beyond that are equal rows
    firsts = cut.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).collect()
    heads = sorted((r["part"], r["first"]) for r in firsts)
    to = {first: heads[k - 1][0] for k, (_, first) in enumerate(heads)}
    if not to:
        return cut.select("part", F.lit(True).alias("own"), "doc_id", "text")
    head = F.coalesce("doc_id", F.lit(-(2**63)))
    lookup = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    goes = F.when(head.isin(*to), F.array(F.struct(F.col("part"), F.lit(True).alias("own")), F.struct(F.element_at(lookup, head).alias("part"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("part"), F.lit(True).alias("own"))))
    rows = cut.withColumn("go", F.explode(goes)).select("go.part", "go.own", "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", F.col("own").desc(), "doc_id", "text")


def _rank(value, bounds: list[int], base: int):
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(value < bounds[mid], _rank(value, bounds[:mid], base)).otherwise(_rank(value, bounds[mid + 1 :], base + mid + 1))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Prints of every document and of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next`` for every row of ``docs``.
    The next document is the one with the next doc_id, after the last the
    first; a lone document is its own next one. Null texts are empty; rows
    without doc_id come before all others. Equal doc_ids are in the order of
    their texts (at the head of a part the least text stands for all of them).
    Texts go through one exchange, in ranges of doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []
        size = 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            pairs = [(x, y[3]) for x, y in zip(held, held[1:]) if x[1] and x[0] == y[0]]
            if pairs:
                own = [x[3] for x, _ in pairs]
                changed = [edited(x[3], y) for x, y in pairs]
                prints = sketches(own + changed + [pairs[-1][1]], width, scale)
                mine, theirs = prints[: len(own)], prints[len(own) : -1]
                index = {id(x): k for k, (x, _) in enumerate(pairs)}
                after = [mine[index[id(y)]] if id(y) in index else (prints[-1] if y[3] is pairs[-1][1] else sketches([y[3]], width, scale)[0]) for x, y in zip(held, held[1:]) if x[1] and x[0] == y[0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(t) for t in own], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                        pa.array([write(p) for p in mine]),
                        pa.array([write(p) for p in theirs]),
                        pa.array([likeness(p, q) for p, q in zip(mine, theirs)], pa.float64()),
                        pa.array([likeness(p, q) for p, q in zip(mine, after)], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            held, size = [] if last else held[-1:], 0

        for batch in batches:
            for part, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held and not own and held[-1][0] == part and not held[-1][1]:
                    continue  # of several heads with one doc_id the least text counts
                held.append((part, own, doc_id, text or ""))
                size += len(text or "") + _ROW
                if size > _CHARS:
                    yield from close(False)
        yield from close(True)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
