import random
import re

import numpy as np
import pytest

from cooframe.llm import _text, components, near_dedup

from .helpers import AWKWARD, docs


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    p, q = find(x), find(y)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(["New", "OTHER", "é"])
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(t)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_all_pairs(spark, width):
    rows = corpus(width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), width).collect()}
    assert got == brute(rows, width, 80)


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_DOCS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = corpus(11)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute(rows, 4, 80)


def test_awkward_rows(spark):
    got = near_dedup.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2
    assert by[None] == [(1, None, True)]
    assert by[10][0][1:] == (6, False)
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_components_by_stars(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (1, None), (2, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components.connected_components(path).collect()} == {0}


def test_slices_of_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"w{k}" for k in range(5000))
    whole = _text.shingles([text], 4)[0]
    monkeypatch.setattr(_text, "_SLICE", 100)
    assert np.array_equal(whole, _text.shingles([text], 4)[0]) and len(whole) == 4997
