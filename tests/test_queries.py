"""Every registered query that has SQL gives the rows of that SQL."""

import pytest

from karst import registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, tables, duck, name):
    same_rows(registry.QUERIES[name](spark, tables).toPandas(), duck.execute(registry.SQL[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_operators(tmp_path):
    """With the subpackage deleted the entry imports and keeps its other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "karst", tmp_path / "karst", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'activity_fetch' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
