import hashlib

import numpy as np

from cooframe.llm import fingerprints as fp

from .helpers import AWKWARD, docs


def test_edited_texts_by_brute_force(spark):
    rows = [(i * 3, f"text {i} " * (i % 17 + 1) + "é日" * (i % 5)) for i in range(60)] + [(1, None), (2, "")]
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[i]
        a, b, c = fp.sketches([t, new, after])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.write(a), fp.write(b))
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, c))


def test_awkward_rows(spark):
    got = fp.edited_fingerprints(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r.doc_id for r in got} == {r[0] for r in AWKWARD}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert fp.edited_fingerprints(docs(spark, [])).collect() == []
    one = fp.edited_fingerprints(docs(spark, [(3, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2))
    small, large = h[rng.permutation(len(h))[:4000]], h
    a, b = fp.sketch(np.sort(small)), fp.sketch(large)
    assert fp.containment(a, b) == 1 and abs(fp.containment(b, a) - 0.1) < 0.03
    assert np.array_equal(fp.merge(fp.sketch(h[:20_000]), fp.sketch(h[20_000:])), b)
    assert np.array_equal(fp.read(fp.write(b)), b)


def true_shingles(text, width=5):
    w = [x for x in text.split() if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_short_passages_are_found_in_long_texts():
    """True containment is 1: every passage of 16 words (12 shingles) from a text of 20,000."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 5000, 20_000)]
    long = fp.sketches([" ".join(words)])[0]
    starts = rng.integers(0, 20_000 - 16, 400)
    found = [fp.containment(p, long) for p in fp.sketches([" ".join(words[s : s + 16]) for s in starts])]
    assert np.mean(found) > 0.99 and np.mean(np.array(found) < 0.9) < 0.01


def test_estimates_against_true_sets():
    rng = np.random.default_rng(6)
    for n in (40, 400, 4000):
        words = [f"v{k}" for k in rng.integers(0, 9000, n)]
        for share in (0.1, 0.5, 0.9):
            other = " ".join(words[: int(n * share)] + [f"x{k}" for k in rng.integers(0, 9000, n - int(n * share))])
            a, b = true_shingles(" ".join(words)), true_shingles(other)
            p, q = fp.sketches([" ".join(words), other])
            true = len(a & b) / len(a)
            assert abs(fp.containment(p, q) - true) < 5 * (true * (1 - true) / (len(a) / 2)) ** 0.5 + 2 / len(a)
            assert abs(len(fp.merge(p, q)) - len(a | b) / 2) < 5 * (len(a | b) / 4) ** 0.5


def test_runs_of_empty_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fp, "_CHARS", 1000)
    got = fp.edited_fingerprints(docs(spark, [(k, None if k % 2 else "") for k in range(300)])).collect()
    assert len(got) == 300 and {(r.n_chars, r.near_next, r.fingerprint) for r in got} == {(0, 1.0, "")}
