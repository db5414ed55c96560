import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) >= 80 and set(sql) <= set(q)
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_package():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    code = "import sys; sys.modules['quadrille.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op1_') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_nothing_else_imports_the_training_data_package():
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent / "quadrille"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text()
