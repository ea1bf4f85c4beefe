"""Facts of Python sources: functions, classes, imports and calls, parsed where files are read.

Grammars of other languages aren't available here; their facts are ingested as tables.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.scratch import ship

FUNCTIONS = "path string, name string, sl int, el int, ln int, cc int, cog int, pc int, bh string, is_public boolean, is_method boolean, calls array<string>"
CLASSES = "path string, name string, bases array<string>, kind string"
IMPORTS = "path string, module string"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
LEAST_BODY = 20


def _inner(node: ast.AST, depth: int = 0) -> Iterator[tuple[ast.AST, int]]:
    """Nodes of a function's body with their branch nesting, without nested functions and classes."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            continue
        yield child, depth
        yield from _inner(child, depth + isinstance(child, _BRANCHES))


def _name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def function_rows(path: str, tree: ast.AST) -> list[tuple]:
    rows = []

    def visit(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                body = list(_inner(child))
                logic = sum(len(n.values) - 1 for n, _ in body if isinstance(n, ast.BoolOp))
                branches = [d for n, d in body if isinstance(n, _BRANCHES)]
                text = "".join(ast.unparse(ast.Module(child.body, [])).split())
                a = child.args
                params = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
                calls = sorted({n for x, _ in body if isinstance(x, ast.Call) and (n := _name(x.func))})
                rows.append((path, child.name, child.lineno, child.end_lineno, child.end_lineno - child.lineno + 1, 1 + len(branches) + logic, sum(1 + d for d in branches) + logic, len([p for p in params if p not in ("self", "cls")]), hashlib.sha256(text.encode()).hexdigest() if len(text) >= LEAST_BODY else "", not child.name.startswith("_"), in_class, calls))
                visit(child, False)
            else:
                visit(child, isinstance(child, ast.ClassDef) or in_class and not isinstance(node, ast.Module))

    visit(tree, False)
    return rows


def class_rows(path: str, tree: ast.AST) -> list[tuple]:
    return [(path, n.name, [b for b in map(_name, n.bases) if b], "class") for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]


def import_rows(path: str, tree: ast.AST) -> list[tuple]:
    found = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {"." * n.level + (n.module or "") for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
    return [(path, m) for m in sorted(found)]


def extract(contents: DataFrame, what: str) -> DataFrame:
    """``what``: functions, classes or imports of (path, content) rows; files that don't parse give none."""
    maker, schema = {"functions": (function_rows, FUNCTIONS), "classes": (class_rows, CLASSES), "imports": (import_rows, IMPORTS)}[what]
    names = [x.split()[0] for x in schema.split(", ")]
    ship(contents.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += maker(path, ast.parse(bytes(content)))
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return contents.select("path", "content").mapInPandas(parse, schema)
