import ast
from pathlib import Path

from prefweave.session import _checkpoints, cut, scratch

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for p in (ROOT / "prefweave").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(".llm" in n for n in names), p


def test_scratch_deletes_its_checkpoints(spark):
    kept = cut(spark.range(10))
    before = _checkpoints(spark)
    with scratch(spark):
        assert cut(spark.range(100)).count() == 100
        assert len(_checkpoints(spark)) == len(before) + 1
    assert _checkpoints(spark) == before and kept.count() == 10
