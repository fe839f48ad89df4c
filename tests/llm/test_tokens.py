import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cooframe.llm import bpe, queries, token_store
from cooframe.llm.shared import new_path

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"
PIECES = ["a", "b", "the", "ing", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "é", "ß", "İ", "Σ", " ", " ", "日本", "<|endoftext|>", "<|startoftext|>", "1", "23", "!!", "...", "‍", "😀", "\x1c", "\x85", "'", "’", "A", "x.\ny"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    t, e, rng = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name)), random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for s in range(0, len(texts), 7):
        ids, ends = e.encode(texts[s : s + 7])
        for k, text in enumerate(texts[s : s + 7]):
            assert ids[ends[k] : ends[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_kind_of_character_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 500)
    t, e, d, rng = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name)), bpe.Decoder(P.path(name)), random.Random(6)
    own = PIECES + ["'ll", "'LL", "\u2009", "\u3000", "\u0663", "\u00b2", "\u2167", "\x00", "\u0345", "\ua66e", "\U0001d538", "\U0001d7d8", "0", "00", "\u0130\u05aa"] + [chr(rng.randrange(0x3000)) for _ in range(300)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(60)]
    for _ in range(400):
        some = ["".join(rng.choice(own) for _ in range(rng.randrange(30))) for _ in range(7)]
        ids, ends = e.encode(some)
        for k, text in enumerate(some):
            want = t.encode(text, add_special_tokens=False).ids
            assert ids[ends[k] : ends[k + 1]].tolist() == want, ascii(text)
            assert d.decode(want) == t.decode(want, skip_special_tokens=False)


def test_ids_that_no_token_has():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, d = Tokenizer.from_file(P.path(name)), bpe.Decoder(P.path(name))
        for ids in ([], [320, 99_999, 321], [49407], [50256]):
            assert d.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_texts_longer_than_a_group(monkeypatch):
    monkeypatch.setattr(bpe, "_CHARS", 300)
    rng = random.Random(9)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name))
        some = ["".join(rng.choice(PIECES[:20]) for _ in range(rng.randrange(900))) for _ in range(30)] + [None, ""]
        ids, ends = e.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_files_of_another_form_go_to_the_library_whole(tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    import json

    spec = json.loads(t.to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    e = bpe.Encoder(path)
    assert e.kind is None and e.encode(["one two", "", None])[0].tolist() == Tokenizer.from_file(path).encode("one two", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tree_concatenation_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "LEAF", 7)
    t, e, rng = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name)), random.Random(4)
    for k in range(300):
        pool = rng.choice(["ab", "etaoinshrdlu", "aaaaab", "thingerandtion", "éêèa", "!?.#", "日本語中国", "a"])
        text = "x " * (k % 2) + "".join(rng.choice(pool) for _ in range(rng.randrange(40, 700)))
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_round_trip_query(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.op8_bpe_round_trip(spark, SF).collect()}
    for d in queries.documents(spark, SF).collect():
        ids = t.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_of_awkward_rows(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs(spark, AWKWARD), path), path).collect()
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in AWKWARD)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.text == t.decode(r.ids, skip_special_tokens=False) for r in got)
    assert bpe.encode(docs(spark, []), path).collect() == []


def expected(rows, end=0):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]


def test_store_query(spark):
    rows = sorted((d.doc_id, d.text) for d in queries.documents(spark, SF).collect())
    got, at = {r.doc_id: r for r in queries.op6_token_store(spark, SF).collect()}, 0
    for i, ids in expected(rows):
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_store_of_awkward_rows(spark):
    path = new_path(spark, "awkward")
    token_store.write(docs(spark, AWKWARD + [(11, AWKWARD[6][1], "en", "a")] * 3), path, P.path("byte_bpe_50k.json"))
    got = token_store.read(spark, path).orderBy("start").collect()
    want = expected([(i, x) for i, x, *_ in AWKWARD] + [(11, AWKWARD[6][1])] * 3)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids) for i, ids in want)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    chunks = token_store.chunks(spark, path)
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert chunks.count() < sum(len(r.hashes) for r in token_store.recipes(spark, path).collect())
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.digests(spark, path).collect()}
    assert sums == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    m = spark.read.parquet(f"{path}/manifest").agg({"tokens": "sum", "documents": "sum"}).first()
    assert sorted(m) == sorted((at, len(got)))


def test_empty_store(spark):
    path = new_path(spark, "empty")
    token_store.write(docs(spark, []), path, P.path("byte_bpe_50k.json"))
    assert token_store.read(spark, path).collect() == [] and token_store.digests(spark, path).collect() == []


def test_damage_is_found():
    ids = np.arange(100, dtype="<u4")
    import zstandard

    payload = zstandard.ZstdCompressor().compress(ids.astype("<u2").tobytes())
    assert np.array_equal(token_store._open(token_store.address(ids), False, payload, zstandard.ZstdDecompressor()), ids)
    with pytest.raises(ValueError):
        token_store._open(token_store.address(ids + 1), False, payload, zstandard.ZstdDecompressor())


@pytest.fixture(scope="module")
def stores(spark):
    """A maker of copies of one small store."""
    import shutil

    rows = [(k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(900)), "en", "a") for k in range(12)] + [(20, None, "en", "a")]
    first = new_path(spark, "sound")
    token_store.write(docs(spark, rows), first, P.path("byte_bpe_50k.json"))

    def copy():
        path = new_path(spark, "copy")
        shutil.copytree(first.removeprefix("file://"), path.removeprefix("file://"))
        return path

    return copy


def changed(spark, path, table, how):
    """One table of a store, rewritten."""
    import shutil

    folder = f"{path}/{table}"
    rows = how(spark.read.parquet(folder))
    kept, schema = rows.collect(), rows.schema
    shutil.rmtree(folder.removeprefix("file://"))
    spark.createDataFrame(kept, schema).write.parquet(folder)


def test_a_sound_store_is_read(spark, stores):
    path = stores()
    assert token_store.digests(spark, path).count() == token_store.read(spark, path).count() == 13


@pytest.mark.parametrize("call", [token_store.digests, token_store.read])
def test_a_lost_or_changed_chunk_is_refused(spark, stores, call):
    path = stores()
    some = bytes(token_store.chunks(spark, path).orderBy("hash").first()["hash"]).hex()
    changed(spark, path, "raw/kind=0", lambda t: t.where(F.hex("hash") != some.upper()))
    with pytest.raises(Exception, match="is missing"):
        call(spark, path).collect()
    path = stores()
    other = bytes(token_store.chunks(spark, path).orderBy(F.desc("hash")).first()["payload"])
    changed(spark, path, "raw/kind=0", lambda t: t.withColumn("payload", F.when(F.hex("hash") == some.upper(), F.lit(other)).otherwise(F.col("payload"))))
    with pytest.raises(Exception, match="address"):
        call(spark, path).collect()


@pytest.mark.parametrize("call", [token_store.digests, token_store.read])
def test_a_changed_recipe_or_manifest_is_refused(spark, stores, call):
    changes = [
        ("recipes", lambda t: t.where("doc_id <> 3")),
        ("recipes", lambda t: t.withColumn("n_tokens", F.when(F.col("doc_id") == 3, F.col("n_tokens") - 1).otherwise(F.col("n_tokens")))),
        ("recipes", lambda t: t.withColumn("hashes", F.when(F.col("doc_id") == 3, F.reverse("hashes")).otherwise(F.col("hashes")))),
        ("recipes", lambda t: t.withColumn("start", F.col("start") + F.when(F.col("doc_id") == 3, 1).otherwise(0))),
        ("manifest", lambda t: t.withColumn("tokens", F.col("tokens") + 1)),
        ("manifest", lambda t: t.where("part <> 0")),
        ("top", lambda t: t.withColumn("parts", F.col("parts") + 1)),
    ]
    for table, how in changes:
        path = stores()
        changed(spark, path, table, how)
        with pytest.raises(Exception, match="match|begins at"):
            call(spark, path).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 30_000).astype("<u4")
    b = np.concatenate([rng.integers(0, 50_000, 1234).astype("<u4"), a])
    parts = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    assert token_store.cuts(a)[-1] == len(a) and len(parts(a) & parts(b)) > 0.8 * len(parts(a))
    crc = zlib.crc32(a.tobytes())
    whole = zlib.crc32(a.tobytes() + b.tobytes())
    assert int(token_store.shifted(np.array([crc]), np.array([len(b)]))[0]) ^ zlib.crc32(b.tobytes()) == whole


def test_long_gaps():
    path = P.path("byte_bpe_50k.json")
    own, library = bpe.Encoder(path), Tokenizer.from_file(path)
    for t in ("a" + " " * 2_000_000 + "b", " " * 2_000_000, "\n" * 1_100_000 + "x"):
        ids, ends = own.encode([t, "next to it"])
        assert library.decode(ids[: ends[1]].tolist(), skip_special_tokens=False) == t


def test_texts_are_cut_at_once_and_each_distinct_word_is_looked_up_once():
    looked = []

    class Counting(bpe.Memo):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    own, whole = bpe.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.memo = Counting()
    texts = ["it's one  two 'twas\n\n we'll'd 　x 12² 日\U0001f600", "it's one", None, " ", "a\0b \0", "\n \n"] * 500 + ["<|endoftext|> it's", "they've'", " \t'll"]
    ids, to = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(looked) < 200


def test_every_character_between_others():
    own, whole = bpe.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["".join(f"{chr(c)} {chr(c)}'s{chr(c)}a" for c in range(s, s + 512) if not 0xD800 <= c < 0xE000) for s in [*range(0, 0x3400, 512), 0xA600, 0xFE00, 0x1F600, 0xE0000]]
    ids, to = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
