import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "covermill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any(n.startswith("covermill.llm") for n in names), path


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
