"""BPE encoding and decoding, with tree concatenation for long text that nothing splits."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import in_groups

#: Words (in the tokenizer's sense) from this length on are encoded by tree concatenation, from leaves of so many symbols, in so many threads.
LONG, LEAF, THREADS = 4096, 1024, 2
#: Memo: words it holds, the longest word it keeps, and ids in all.
MEMO, MEMO_CHARS, MEMO_IDS = 400_000, 40, 1 << 23
#: Times MEMO that the memo holds under the form ``bytes``.
MORE = 2
_CHARS = 1 << 20
#: Words that the library encodes as one text, joined by a word whose id is known, and such texts in a call.
_AT_ONCE, _CALLS = 1000, 16
LETTER, NUMBER, SPACE, OTHER = range(1, 5)
#: The symbol of each byte in byte-level BPE: its own character if that is visible, else one from 256 on, in order.
_SEEN = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
SYMBOLS = {b: chr(b) if b in _SEEN else chr(256 + b - bisect_left(_SEEN, b)) for b in range(256)}


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Tree:
    """Encodes one long run of symbols: leaves in parallel, then joins, level by level.

    At each join a window around it is encoded anew, twice as wide each time,
    until its outer tokens on both sides are those that were there. Neighbours
    that BPE leaves apart on their own it leaves apart in any text, so the
    joined tokens are then those of the whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inner = Tokenizer(models.BPE(model["vocab"], merges))
        self.last = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.words = {i: w for w, i in model["vocab"].items()}
        self.pool = ThreadPoolExecutor(THREADS)

    def encode(self, symbols: str) -> list[int]:
        cuts = [symbols[i : i + LEAF] for i in range(0, len(symbols), LEAF)]
        share = -(-len(cuts) // THREADS)
        # the library works outside Python's lock, so the shares are encoded at the same time
        halves = self.pool.map(lambda s: [e.ids for e in self.inner.encode_batch_fast(cuts[s : min(s + share, len(cuts) - 1)], add_special_tokens=False)], range(0, len(cuts), share))
        parts = [ids for half in halves for ids in half]
        parts.append(self.last.encode(cuts[-1], add_special_tokens=False).ids)
        while len(parts) > 1:
            joined = [self.join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) & ~1 :]
        return parts[0]

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            text = "".join(self.words[i] for i in a + b)
            if all_right and final:
                new = self.last.encode(text[: len(text) - len(self.suffix)], add_special_tokens=False).ids
            else:
                new = self.inner.encode(text, add_special_tokens=False).ids
            if (all_left or new[:2] == a[:2]) and (all_right or new[-2:] == b[-2:]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            width *= 2


def _kind(spec: dict) -> str | None:
    """``bytes`` or ``words`` for the two forms of file whose split into words is known here, None for any other."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or not plain:
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None:
        return "bytes"
    split = (pre.get("pretokenizers") or [{}])[0]
    if split.get("type") == "Split" and split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and split.get("invert") and split.get("behavior") == "Removed":
        names = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        return "words" if names == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre["pretokenizers"][1:]] == ["ByteLevel"] else None
    return None


class Words:
    """Splits texts into words exactly as a tokenizer does.

    What is a letter, a number or white space is asked of the tokenizer itself,
    for each block of 256 code points when one first occurs, so no table of
    another Unicode version comes in.
    """

    def __init__(self, tokenizer, kind: str) -> None:
        self.split, self.kind = tokenizer.pre_tokenizer.pre_tokenize_str, kind
        self.classes = np.zeros(0x110000, np.uint8)
        self.blocks: set[int] = set()
        self.unknown = None
        self.learn({0})
        self.ascii = self.pattern

    def _class(self, c: str) -> int:
        whole = lambda t: [s for _, s in self.split(t)] == [(0, len(t))]
        if whole("a" + c):
            return LETTER
        if whole("." + c):
            return OTHER
        if self.kind == "words":
            return NUMBER if self.split(c) else SPACE
        return NUMBER if whole("1" + c) else SPACE

    def learn(self, blocks: set[int]) -> None:
        if blocks <= self.blocks:
            return
        for b in blocks - self.blocks:
            for c in range(b * 256, b * 256 + 256):
                self.classes[c] = OTHER if 0xD800 <= c < 0xE000 else self._class(chr(c))
        self.blocks |= blocks
        letter, number, space = (self._range(k) for k in (LETTER, NUMBER, SPACE))
        marks = "'(?:s|t|re|ve|m|ll|d)"
        if self.kind == "bytes":
            pattern = rf"{marks}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        else:
            pattern = rf"{marks}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
        self.pattern = re.compile(pattern)
        self.unknown = re.compile("[^" + "".join(rf"\U{b * 256:08x}-\U{b * 256 + 255:08x}" for b in sorted(self.blocks)) + "]")

    def _range(self, k: int) -> str:
        on = np.flatnonzero(self.classes == k)
        runs = np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)
        return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs if len(r))

    def find(self, text: str):
        """The pattern for a text, all of whose characters it knows."""
        if text.isascii():
            return self.ascii
        if self.unknown.search(text):
            self.learn({ord(c) >> 8 for c in set(text)})
        return self.pattern


    def starts(self, raw: bytes, gaps: np.ndarray) -> np.ndarray:
        """First bytes of the words of UTF-8 texts under the pattern of ``bytes``; ``gaps``, each a byte between two texts, are words too."""
        b = np.frombuffer(raw, np.uint8)
        kind = np.where(np.arange(256) < 128, self.classes[:256], 0).astype(np.uint8)[b]
        lead = np.flatnonzero(b >= 0xC0)
        if len(lead):
            first = b[lead]
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = (first & np.array([0x1F, 0x0F, 0x07], np.uint8)[size - 2]).astype(np.int32)
            for k in range(1, 4):
                on = size > k
                code[on] = code[on] << 6 | b[lead[on] + k] & 0x3F
            self.learn(set(np.unique(code >> 8).tolist()))
            own = self.classes[code]
            for k in range(4):
                on = size > k
                kind[lead[on] + k] = own[on]
        kind[gaps] = 0
        start = np.empty(len(b), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        # the last white space before a word stands alone, and is the word's own if it is a plain space
        run = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != 0)) + 1
        last = run - 1
        for _ in range(3):
            last = last - (b[last] & 0xC0 == 0x80)
        start[last] = True
        start[run[b[last] == 0x20]] = False
        mark = np.flatnonzero(b == 0x27)
        mark = mark[start[mark]]
        after = np.frombuffer(raw + b"\0\0", np.uint8)
        x, y = after[mark + 1], after[mark + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        start[mark[one | two] + 1] = False
        end = np.concatenate([mark[one] + 2, mark[two] + 3])
        start[end[end < len(b)]] = True
        return np.flatnonzero(start)


class Memo(dict):
    """Word to its place in the memo's tables; a word not yet there gets the next place and waits for its ids."""

    def __init__(self) -> None:
        self.waiting: list[str] = []
        self.places = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = self.places
        self.places += 1
        self.waiting.append(word)
        return at


class Encoder:
    """Ids of whole texts, exactly as the tokenizers library gives them.

    Texts are cut into words where the tokenizer cuts them (under the form
    ``bytes`` many texts at once, by the classes of their bytes); the library encodes
    each distinct word once, many in a call, and a bounded memo keeps the ids
    of words that return. Texts that hold the string of a special token, and
    all texts under a file of another form, are encoded by the library whole.
    """

    def __init__(self, path: str) -> None:
        full = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        # where words are encoded, the whole tokenizer is loaded again by the first text that needs it: two of them are much memory
        self.full = None if self.kind else full
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.path, self.tree = path, None
        if self.kind:
            from tokenizers import Tokenizer, pre_tokenizers

            self.words = Words(full, self.kind)
            self.normalizer, self.pre_tokenizer = full.normalizer, full.pre_tokenizer
            del full
            # words are of normalised text, which another pass might change
            bare = spec | {"normalizer": None, "truncation": None, "padding": None}
            if self.kind == "bytes":  # they come as symbols, so that nothing is left but merges
                self.plain = Tokenizer.from_str(json.dumps(bare | {"post_processor": None, "decoder": None, "added_tokens": []}))
                self.plain.pre_tokenizer = pre_tokenizers.Split(SYMBOLS[10], "isolated")
            else:
                self.plain = Tokenizer.from_str(json.dumps(bare))
            # no other word has the separator's id: a digit is never part of one; words with a line end are encoded alone
            self.separator = "\n" if self.kind == "bytes" else " 0 "
            (self.separator_id,) = self._word(self.separator)
        self._clear()

    def _clear(self) -> None:
        self.memo, self.flat = Memo(), np.empty(1 << 16, np.uint32)
        self.first, self.size, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.filled = 0

    def _whole(self, text: str) -> list[int]:
        self.full = self.full or load(self.path)
        return self.full.encode(text, add_special_tokens=False).ids

    def _word(self, words: str) -> list[int]:
        return self.plain.encode(self._symbols(words), add_special_tokens=False).ids

    def _symbols(self, words: str) -> str:
        return words.encode().decode("latin-1").translate(SYMBOLS) if self.kind == "bytes" else words

    def _long(self, word: str) -> list[int]:
        self.tree = self.tree or Tree(self.path)
        ((symbols, _),) = self.pre_tokenizer.pre_tokenize_str(word)
        return self.tree.encode(symbols)

    def _put(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.first[places] = self.filled + np.cumsum(sizes) - sizes
        self.size[places] = sizes
        self.filled += len(ids)

    def _learn(self) -> None:
        """Ids for the words that wait."""
        memo, waiting = self.memo, self.memo.waiting
        while memo.places > len(self.first):
            self.first, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.used))
        base = memo.places - len(waiting)
        sign = self.separator.strip() or self.separator
        # a separator in a word would cut it; a long word is the tree's
        alone = [k for k, w in enumerate(waiting) if sign in w or len(w) >= LONG] if any(map(LONG.__le__, map(len, waiting))) or sign in "".join(waiting) else []
        apart = set(alone)
        short = [k for k in range(len(waiting)) if k not in apart] if apart else range(len(waiting))
        words = [waiting[k] for k in short] if apart else waiting
        at = base + np.array(short, np.int64)
        for s in range(0, len(words), _AT_ONCE * _CALLS):
            # what the library makes of a run is far larger than its ids, so few runs are held at a time
            runs = range(s, min(s + _AT_ONCE * _CALLS, len(words)), _AT_ONCE)
            for r, found in zip(runs, self.plain.encode_batch_fast([self._symbols(self.separator.join(words[r : r + _AT_ONCE])) for r in runs], add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                ends = np.append(np.flatnonzero(ids == self.separator_id), len(ids))
                if len(ends) != len(at[r : r + _AT_ONCE]):
                    raise RuntimeError("words ran into one another")
                sizes = np.diff(ends, prepend=-1) - 1
                self._put(at[r : r + _AT_ONCE], ids[ids != self.separator_id], sizes)
        for k in alone:
            ids = np.array(self._long(waiting[k]) if len(waiting[k]) >= LONG else self._whole(waiting[k]) if self.kind == "bytes" else self._word(waiting[k]), np.uint32)
            self._put(np.array([base + k]), ids, np.array([len(ids)]))
        for w in [w for w in waiting if len(w) > MEMO_CHARS]:
            del memo[w]
        waiting.clear()

    def _most(self) -> int:
        return MEMO * MORE if self.kind == "bytes" else MEMO

    def _forget(self) -> None:
        """Keep the words that came back, most used first, half of the memo at most."""
        old, first, size, used, flat = self.memo, self.first, self.size, self.used, self.flat
        again = [(w, p) for w, p in old.items() if used[p] > 1]
        if len(again) > self._most() // 2:
            least = np.partition(np.array([used[p] for _, p in again]), len(again) - self._most() // 2)[len(again) - self._most() // 2]
            again = [(w, p) for w, p in again if used[p] > least]
        self._clear()
        if again:
            places = np.array([p for _, p in again])
            for w, _ in again:
                self.memo[w]
            self.memo.waiting.clear()
            while self.memo.places > len(self.first):
                self.first, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.used))
            self._put(np.arange(len(places)), _gather(flat, first[places], size[places]), size[places])

    def _ids(self, text: str) -> Iterator[np.ndarray]:
        """Places of a text's words in the memo, a bounded number at a time."""
        if self.kind == "words":
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        find, get = self.words.find(text), self.memo.__getitem__
        if len(text) <= _CHARS:
            yield np.array(list(map(get, find.findall(text))), np.int64)
        else:
            words = (m[0] for m in find.finditer(text))
            while len(some := list(islice(words, 100_000))):
                yield np.array(list(map(get, some)), np.int64)

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of many texts in the memo, each distinct word looked up once, and the number of each text's words."""
        raw = "\0".join(texts).encode()
        gaps = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts])[:-1] + np.arange(len(texts) - 1)
        starts = self.words.starts(raw, gaps)
        at = np.searchsorted(starts, gaps)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        which = np.delete(found.indices.to_numpy(), at)
        known = np.array(list(map(self.memo.__getitem__, found.dictionary.to_numpy(zero_copy_only=False))), np.int64)
        return known[which], np.diff(at, prepend=-1, append=len(starts)) - 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end; null is empty."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts) + 1, np.int64)
        held: list[np.ndarray] = []
        counts: list[int] = []
        owners: list[int] = []
        ready: list[str] = []

        def flush() -> None:
            """Ids of the words held so far, in one gathering."""
            if ready:
                places, found = self._many(ready)
                held.append(places)
                counts.extend(found.tolist())
                ready.clear()
            if not held:
                return
            self._learn()
            places = np.concatenate(held)
            of = self.size[places]
            parts.append(_gather(self.flat, self.first[places], of))
            self.used[: self.memo.places] += np.bincount(places, minlength=self.memo.places)
            ends = np.concatenate([[0], np.cumsum(of)])
            at = np.cumsum([0, *counts])
            np.add.at(sizes, np.array(owners) + 1, ends[at[1:]] - ends[at[:-1]])
            held.clear()
            counts.clear()
            owners.clear()
            if len(self.memo) > self._most() or self.filled > MEMO_IDS:
                self._forget()

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.kind or any(m in text for m in self.marks):
                flush()
                parts.append(np.array(self._whole(text), np.uint32))
                sizes[k + 1] = len(parts[-1])
                continue
            if self.kind == "bytes" and len(text) <= _CHARS:
                ready.append(text)
                owners.append(k)
                continue
            if ready:
                flush()
            for places in self._ids(text):
                held.append(places)
                counts.append(len(places))
                owners.append(k)
                if len(text) > _CHARS:
                    flush()
        flush()
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.cumsum(sizes)


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its memo lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str):
    """For mapInArrow over (doc_id, text): batches of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in in_groups([len(t or "") for t in texts], _CHARS):
                ids, ends = own.encode(texts[s:e])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

    return run


def id_lists(column: pa.Array) -> list[list[int]]:
    """A column of id arrays as lists, by way of NumPy; a null is empty."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


class Decoder:
    """Texts of ids, as the tokenizers library decodes them, special tokens included."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.words = None
        if self.tokenizer.decoder is None:  # then tokens are joined by spaces, and ids that none has count for nothing
            known = self.tokenizer.get_vocab(with_added_tokens=True)
            self.words = [None] * (max(known.values(), default=-1) + 1)
            for w, i in known.items():
                self.words[i] = w
            self.tokenizer = None

    def decode(self, ids: list[int]) -> str:
        if self.words is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""
        try:
            return " ".join(map(self.words.__getitem__, ids)) if not ids or min(ids) >= 0 else self._some(ids)
        except (IndexError, TypeError):
            return self._some(ids)

    def _some(self, ids: list[int]) -> str:
        return " ".join(w for i in ids if 0 <= i < len(self.words) and (w := self.words[i]) is not None)


def decoded(path: str):
    """For batches of (doc_id, ids): batches of (doc_id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.decode(x) for x in id_lists(batch.column(1))], pa.string())], ["doc_id", "ids", "text"])

    return run


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs`` (doc_id, text).

    ``path``: a tokenizers file. Null and empty texts have no ids. Rows with
    equal doc_id stay apart; other columns are ignored; an empty table gives
    an empty one. Memory is bounded by the memo and one text with its ids.
    """
    return _docs(docs).mapInArrow(encoded(path), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` for rows (doc_id, ids), special tokens included; null ids give an empty text."""
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decoded(path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, then, schema: str) -> DataFrame:
    """Encode, decode and hand the batches of (doc_id, ids, text) to ``then`` in the same pass."""
    first, second = encoded(path), decoded(path)
    return _docs(docs).mapInArrow(lambda batches: then(second(first(batches))), schema)
