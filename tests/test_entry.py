import __spark_entry__ as entry_module


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_training_data_operators_are_optional():
    """Without the optional subpackage the module still imports."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('tidemark.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'cb_q12' in e.queries() and not any(k.startswith('op') for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry_module.__file__).parent)
