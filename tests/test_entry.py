import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"i", "v"}


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and rel.parts[0] in ("cooframe", "__spark_entry__.py"):
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spmv' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_core_queries_outlast_a_missing_library():
    """Without a library that only the training-data subpackage needs, the entry module imports and has all other queries."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 180 and not any(q.startswith('op1_') for q in e.queries())"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
