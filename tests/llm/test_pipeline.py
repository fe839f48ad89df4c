from cooframe.llm import near_dedup

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def test_stages_hold_together(spark):
    import corpus_pipeline as P

    columns = docs(spark, []).columns
    table = docs(spark, [*AWKWARD, (30, "mail someone@example.com now or never again", "en", "a")])
    for name, stage in P.STAGES[:-1]:
        before = table
        table = P.written(stage(spark, table, SF), "stage")
        assert table.columns == columns, name
        if "language" in name:
            assert table.where("text is null or trim(text) = ''").count() == 0
        if "near" in name:
            assert table.count() == table.select("doc_id", "text").distinct().count()
            assert {r.doc_id for r in table.select("doc_id").collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        if name == "PII":
            assert table.where("text like '%someone@%'").count() == 0 and table.count() == before.count()
            assert table.where("pii = 'own'").count() == before.count()
    out = P.STAGES[-1][1](spark, table, SF)
    assert out.count() == table.count()
    for _, stage in P.STAGES:
        assert stage(spark, docs(spark, []), SF).collect() == []


def test_run_over_the_table(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None
    rows = P.run(spark, SF).collect()
    kept = near_dedup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").count()
    assert len({r.doc_id for r in rows}) <= kept and len(rows) > kept and all(r.n_tokens == len(r.ids) for r in rows)
