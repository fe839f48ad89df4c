from pyspark.sql import functions as F

from cooframe.llm import mixing, queries

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, fixed, live = share * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(w[s] for s in live)
        over = {s for s in live if left * w[s] / total > most * sizes[s]} if live else set()
        if not over:
            return fixed | {s: left * w[s] / total for s in live}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
        live -= over


def test_targets_and_takings(spark):
    got = mixing.mix(queries.documents(spark, SF)).collect()
    sizes, taken, target, most = {}, {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        most[r.source] = max(most.get(r.source, 0), r.size)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= most[s]
    again = mixing.mix(queries.documents(spark, SF).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_small_buckets_change_nothing(spark, monkeypatch):
    want = {(r.doc_id, r.taken) for r in mixing.mix(queries.documents(spark, SF)).collect()}
    monkeypatch.setattr(mixing, "BUCKET", 5)
    assert {(r.doc_id, r.taken) for r in mixing.mix(queries.documents(spark, SF)).collect()} == want


def test_awkward_rows(spark):
    got = mixing.mix(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0} and all(r.taken <= 2 * r.size for r in got)
    rows = mixing.mixed(docs(spark, AWKWARD))
    assert rows.columns == docs(spark, []).columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mixed(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [(1, None, "en", "a")])).first().taken == 0


def scales(rows, wanted):
    """The scale at which chances min(1, scale * weight) expect ``wanted`` words, by halving."""
    weight = lambda n: max(1, 32 - max(1, n.bit_length()))
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1.0, mid * weight(n)) for n in rows) < wanted else (low, mid)
    return lambda n: min(1.0, low * weight(n))


def test_chances_ranks_and_takings_by_brute_force(spark):
    rows = spark.createDataFrame([(k, "w " * (1 + k * k % 700), "abc"[k % 3]) for k in range(240)], "doc_id long, text string, source string")
    got = mixing.mix(rows, seed="s").collect()
    u = {r.doc_id: r.u for r in rows.select("doc_id", mixing.draw(F.col("doc_id"), "s").alias("u")).collect()}
    assert len({r.chance for r in got if r.source == "b"}) > 3  # unequal within a source
    swapped = 0
    for source in "abc":
        own = [r for r in got if r.source == source]
        size = sum(r.size for r in own)
        whole = int(own[0].target // size)
        wanted = own[0].target - whole * size
        if wanted < 1e-9:
            assert {r.copies for r in own} == {whole}
            continue
        chance = scales([r.size for r in own], wanted)
        assert all(abs(r.chance - chance(r.size)) < 1e-9 for r in own) and abs(sum(r.size * r.chance for r in own) - wanted) < 1e-6
        odds = lambda p: p / (1 - p)
        order = sorted(own, key=lambda r: (0.0 if r.chance >= 1 else odds(u[r.doc_id]) / odds(r.chance), r.doc_id))
        swapped += [r.doc_id for r in order] != sorted((r.doc_id for r in own), key=u.get)
        at = 0
        for r in order:
            at += r.size
            assert r.copies == whole + (at - r.size / 2 <= wanted), r
    assert swapped


def test_copies_come_as_often_as_their_chance(spark):
    sizes = [1, 3, 40, 500, 6000]
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr(f"repeat('w ', element_at(array({', '.join(map(str, sizes))}), int(id % 5 + 1)))").alias("text"), F.when(F.col("id") % 7 < 4, "a").otherwise("b").alias("source"))
    found = mixing.mix(rows, share=0.7).where("chance > 0").groupBy("source", "size").agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("share"), F.avg("chance").alias("chance"), F.count("*").alias("n")).collect()
    assert len({round(r.chance, 6) for r in found}) >= 5
    for r in found:
        assert abs(r.share - r.chance) < 5 * (r.chance * (1 - r.chance) / r.n) ** 0.5 + 0.004, r
