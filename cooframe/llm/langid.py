"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import in_groups

DIMENSIONS = 1024
#: Documents of each language that its profile is learned from, in expectation; of a language with fewer, all.
SAMPLE = 2048
UNKNOWN = "und"
_CHARS = 1 << 19
_letters: list[np.ndarray] = []


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """A random vector of +1 and -1, the same everywhere for a code point; 0 is the edge of a word."""
    return (np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters in use, the trigrams (three places among them, a column each), and each occurrence's trigram and text.

    Letters are lower-cased; all else is an edge. Trigrams are centred on a
    letter, so none reaches from one text into another.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(_is_letter()[codes], codes, 0)
    padded = np.concatenate([[0], symbols, [0]])
    at = np.flatnonzero(symbols)
    if not len(at):
        return np.empty(0, np.uint32), np.empty((3, 0), np.int64), at, at
    seen = np.zeros(0x110000, bool)
    seen[symbols] = True
    seen[0] = True
    used = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[used] = np.arange(len(used))
    n = len(used)
    code = (place[padded[at]] * n + place[padded[at + 1]]) * n + place[padded[at + 2]]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at, side="right")
    if n**3 <= 1 << 22:
        there = np.zeros(n**3, bool)
        there[code] = True
        kinds = np.flatnonzero(there)
        column = np.zeros(n**3, np.int64)
        column[kinds] = np.arange(len(kinds))
        column = column[code]
    else:
        kinds, column = np.unique(code, return_inverse=True)
    return used, np.stack([kinds // (n * n), kinds // n % n, kinds % n]), column, text


def bundles(texts: list[str]) -> np.ndarray:
    """One vector for each text: the sum of its trigrams' vectors, each the product of three letter vectors turned by 2, 1 and 0 places.

    Texts are counted by trigrams a slice of 4,096 trigrams at a time, so many
    different letters cost time and no memory.
    """
    used, kinds, column, text = trigrams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not len(used):
        return out
    plain = np.stack([letter_vector(int(c)) for c in used])
    one, two = np.roll(plain, 1, axis=1), np.roll(plain, 2, axis=1)
    slices = -(-kinds.shape[1] // 4096)
    if slices > 1:
        order = np.argsort(column >> 12, kind="stable")
        column, text = column[order], text[order]
    ends = np.searchsorted(column >> 12, np.arange(slices + 1)) if slices > 1 else [0, len(column)]
    for k in range(slices):
        a, b, c = kinds[:, k * 4096 : (k + 1) * 4096]
        cell = text[ends[k] : ends[k + 1]] * len(a) + column[ends[k] : ends[k + 1]] - k * 4096
        counts = np.bincount(cell, minlength=len(texts) * len(a)).reshape(len(texts), len(a)).astype(np.float32)
        out += counts @ (two[a] * one[b] * plain[c]).astype(np.float32)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for s, e in in_groups([len(t) + 512 for t in texts], _CHARS):
        yield s, e, texts[s:e]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for s, e, texts in _groups(batch):
            for lang, v in zip(batch.column(0).slice(s, e - s).to_pylist(), unit(bundles(texts)).astype(np.float64)):
                total[lang] = total.get(lang, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])


def fit(docs: DataFrame, eligible, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit profile of each language: the sum of its documents' unit vectors.

    Learns from text and non-null lang of the rows of ``docs`` for which the
    column ``eligible`` holds: of each language a share, chosen by a hash of
    doc_id, of ``sample`` documents in expectation, so a language that is rare
    has its profile at every size. No such row: no profile. Texts of any length
    count as one vector of length 1; repeated rows count each.
    """
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().collect()  # a row for each language, as the profiles are
    bounds = docs.sparkSession.createDataFrame([(r["lang"], (1 << 30) * sample / r["count"]) for r in counts], "of string, bound double")
    rows = rows.join(F.broadcast(bounds), F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("bound"))
    partial = rows.select("lang", "text").repartition(6).mapInArrow(_profiles, "lang string, v array<double>").collect()  # at most 6 rows a language
    total: dict[str, np.ndarray] = {}
    for r in sorted(partial, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    return {lang: unit(total[lang]) for lang in sorted(total)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``keep`` for every row of ``docs`` (doc_id, text).

    ``score`` is the cosine with the predicted language's profile, at least 0.
    Null texts and texts without a letter are ``und`` with score 0, as is all
    where no profile was learned; of equal cosines the first language in code
    point order wins. Rows with equal doc_id are predicted each on its own.
    """
    names = list(profiles)
    matrix = np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kept = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in _groups(batch):
                own = bundles(texts)
                known = np.any(own, axis=1) & bool(names)
                near = unit(own) @ matrix.T if names else np.zeros((len(texts), 1), np.float32)
                best = near.argmax(1)
                score = np.where(known, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *(batch.column(2 + i).slice(s, e - s) for i in range(len(kept))), pa.array(lang), pa.array(score)], ["doc_id", *(n for n, _ in kept), "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"`{n}` {t}" for n, t in kept), "lang_pred string", "score double"]))


def held_out(doc_id):
    """True for the fifth of documents that no model learns from; also where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
