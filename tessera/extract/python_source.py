"""Symbols of Python sources by Python's own grammar."""

from __future__ import annotations

import ast
import hashlib

BRANCH = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case)
NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.match_case, ast.With, ast.AsyncWith, ast.Lambda)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def complexity(node: ast.AST) -> dict:
    """Cyclomatic (1 + branches + boolean operators), cognitive (branches weigh their nesting), deepest nesting, parameters, lines."""
    out = {"cyclomatic": 1, "cognitive": 0, "max_nesting": 0}

    def walk(n: ast.AST, depth: int, chained: bool = False) -> None:
        if isinstance(n, BRANCH):
            out["cyclomatic"] += 1
            out["cognitive"] += 1 + depth
        if isinstance(n, ast.BoolOp):
            more = len(n.values) - 1
            out["cyclomatic"] += more
            out["cognitive"] += more
        inner = depth + 1 if isinstance(n, NEST) and not chained else depth
        out["max_nesting"] = max(out["max_nesting"], inner)
        for name, value in ast.iter_fields(n):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    # an elif stands beside its if, not below it
                    beside = isinstance(n, ast.If) and name == "orelse" and len(n.orelse) == 1 and isinstance(child, ast.If) and child.col_offset == n.col_offset
                    walk(child, inner, beside)

    for child in node.body:
        walk(child, 0)
    a = node.args
    out["param_count"] = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
    out["loc"] = node.end_lineno - node.lineno + 1
    return out


def _name(n: ast.AST) -> str:
    return n.attr if isinstance(n, ast.Attribute) else n.id if isinstance(n, ast.Name) else ""


def _calls(body: list) -> list[str]:
    found: dict[str, None] = {}

    def walk(n: ast.AST) -> None:
        if isinstance(n, DEFS):
            return
        if isinstance(n, ast.Call) and _name(n.func):
            found.setdefault(_name(n.func))
        for c in ast.iter_child_nodes(n):
            walk(c)

    for n in body:
        walk(n)
    return list(found)


def _imports(tree: ast.Module) -> list[str]:
    found: dict[str, None] = {}
    for n in tree.body:
        if isinstance(n, ast.Import):
            for a in n.names:
                found.setdefault(a.name)
        elif isinstance(n, ast.ImportFrom):
            found.setdefault("." * n.level + (n.module or ""))
    return list(found)


def extract(source: str, file: str) -> list[dict]:
    """Rows of classes, functions, methods and constants; none if the source can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    data = source.encode("utf-8", "replace")
    starts = [0]
    for line in data.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    rows: list[dict] = []

    def span(n: ast.AST) -> tuple[int, int]:
        return starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset

    def row(n: ast.AST, name: str, kind: str, parent: dict | None, **more) -> dict:
        a, b = span(n)
        r = {"file": file, "name": name, "qualified_name": f"{parent['name']}.{name}" if parent else name, "kind": kind, "language": "python", "parent": parent, "line": n.lineno, "end_line": n.end_lineno, "byte_offset": a, "byte_length": b - a, "content_hash": hashlib.sha256(data[a:b]).hexdigest(), "signature": "", "docstring": "", "decorators": [], "calls": [], "imports": [], "inherits_from": [], "implements": [], "complexity": None}
        r.update(more)
        rows.append(r)
        return r

    def head(n: ast.AST) -> str:
        a, _ = span(n)
        return data[a : span(n.body[0])[0]].decode("utf-8", "replace").rstrip(" \t\n:") if n.body[0].lineno > n.lineno or True else ""

    def walk(n: ast.AST, parent: dict | None) -> None:
        if isinstance(n, DEFS):
            cls = isinstance(n, ast.ClassDef)
            more = {"docstring": (ast.get_docstring(n) or "").strip(), "decorators": [f"@{ast.unparse(d)}" for d in n.decorator_list], "signature": head(n).split('"""')[0].rstrip(" \t\n:")}
            if cls:
                more["inherits_from"] = [x for x in dict.fromkeys(_name(b.value if isinstance(b, ast.Subscript) else b) for b in n.bases) if x]
            else:
                more |= {"calls": _calls(n.body), "complexity": complexity(n)}
            parent = row(n, n.name, "class" if cls else "method" if parent else "function", parent, **more)
        elif isinstance(n, ast.Assign) and parent is None and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            name = n.targets[0].id
            if name.isupper() or (len(name) > 1 and name[0].isupper() and "_" in name):
                a, b = span(n)
                row(n, name, "constant", None, signature=data[a:b].decode("utf-8", "replace").strip()[:100])
        for c in ast.iter_child_nodes(n):
            walk(c, parent)

    walk(tree, None)
    imports = _imports(tree)
    top = [r for r in rows if r["parent"] is None]
    if imports and not top:
        rows.append({"file": file, "name": "(module)", "qualified_name": "(module)", "kind": "symbol", "language": "python", "parent": None, "line": 1, "end_line": 1, "byte_offset": 0, "byte_length": 0, "content_hash": "", "signature": file, "docstring": "", "decorators": [], "calls": [], "imports": imports, "inherits_from": [], "implements": [], "complexity": None})
    for r in top:
        r["imports"] = imports
    return rows
