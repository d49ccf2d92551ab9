"""Undefined and unused names in every module of the library."""

import ast
import builtins
import importlib
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
FILES = sorted(p for p in [*ROOT.glob("serploom/**/*.py"), ROOT / "__spark_entry__.py", ROOT / "bench.py"])
OWN = {"__file__", "__name__", "__doc__"}


def _bound(tree):
    """Every name that a module binds somewhere: good enough to find the import that was lost."""
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
            yield n.id
        elif isinstance(n, ast.FunctionDef | ast.ClassDef):
            yield n.name
        elif isinstance(n, ast.arg):
            yield n.arg
        elif isinstance(n, ast.ExceptHandler) and n.name:
            yield n.name


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names(path):
    tree = ast.parse(path.read_text())
    imported = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names} - {"annotations"}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    assert not imported - used, f"unused imports: {sorted(imported - used)}"
    missing = used - imported - set(_bound(tree)) - set(dir(builtins)) - OWN
    assert not missing, f"undefined: {sorted(missing)}"


def test_modules_import():
    for path in FILES:
        parts = path.relative_to(ROOT).with_suffix("").parts
        if parts[0] == "serploom" and "llm" not in parts:
            importlib.import_module(".".join(p for p in parts if p != "__init__"))
