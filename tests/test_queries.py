"""Every query of the core engine against DuckDB."""

import pytest

from sheetflow import catalogue

from .helpers import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_the_llm_package():
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    code = textwrap.dedent("""
        import sys
        class Hidden:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("sheetflow.llm"):
                    raise ImportError(name)
        sys.meta_path.insert(0, Hidden())
        import __spark_entry__ as e
        assert "seq_gate" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
