"""One Python source as plain syntax nodes, scope by scope.

Nothing is judged here. Nodes come in evaluation order, children before their
parent, so a node's children and all earlier statements have smaller numbers.
``block`` names the branches and loops a node lies in, as ``number:arm``."""

from __future__ import annotations

import ast

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Fields whose statements run under a condition, and the arm they form.
_ARMS = {(ast.If, "body"): "a", (ast.If, "orelse"): "b", (ast.For, "body"): "loop", (ast.AsyncFor, "body"): "loop", (ast.While, "body"): "loop"}


def _value(n: ast.AST) -> str:
    """What distinguishes nodes of one kind: a name, a literal's type, an operator."""
    if isinstance(n, ast.Constant):
        return f"{type(n.value).__name__} {n.value}" if isinstance(n.value, bool) else type(n.value).__name__
    if isinstance(n, ast.BinOp):
        return type(n.op).__name__
    for field in ("id", "attr", "arg"):
        if isinstance(getattr(n, field, None), str):
            return getattr(n, field)
    return ""


class _Text:
    """Source text of a node; columns of the parser count bytes."""

    def __init__(self, source: str):
        self.raw = source.encode("utf-8")
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line.encode("utf-8")))

    def __call__(self, n: ast.AST) -> str:
        if getattr(n, "lineno", None) is None:
            return ""
        return self.raw[self.starts[n.lineno - 1] + n.col_offset:self.starts[n.end_lineno - 1] + n.end_col_offset].decode("utf-8", "replace")


def _scope(roots: list[ast.AST], text: _Text) -> list[dict]:
    """Nodes below ``roots`` without those of nested definitions."""
    out: list[dict] = []

    def visit(n: ast.AST, block: list[str]) -> int:
        first, number, kids, roles = len(out), len(out), [], []
        for field, value in ast.iter_fields(n):
            for i, child in enumerate(value if isinstance(value, list) else [value]):
                if not isinstance(child, ast.AST) or isinstance(child, (*_DEFINITIONS, ast.expr_context, ast.operator)):
                    continue
                arm = _ARMS.get((type(n), field)) or (f"c{i}" if isinstance(child, (ast.ExceptHandler, ast.match_case)) else None)
                kids.append(visit(child, [*block, f"{number}:{arm}"] if arm else block))
                roles.append(field)
        out.append({"kind": type(n).__name__, "value": _value(n), "text": text(n), "line": getattr(n, "lineno", 0), "first": first, "kids": kids, "roles": roles, "block": block})
        return len(out) - 1

    for root in roots:
        if not isinstance(root, _DEFINITIONS):
            visit(root, [])
    return out


def _parameters(fn) -> tuple[list[str], list[str]]:
    """All parameters as written, and the names that arguments bind to in order."""
    a = fn.args
    named = [x.arg for x in [*a.posonlyargs, *a.args]]
    shown = named + [x.arg for x in a.kwonlyargs] + ([f"*{a.vararg.arg}"] if a.vararg else []) + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return shown, [p for p in named + [x.arg for x in a.kwonlyargs] if p not in ("self", "cls")]


def flatten(source: str) -> list[dict]:
    """One record for the module, then one per function in source order. A
    function's record also holds the module's plain assignments (``outer``), so
    that it can be read by itself."""
    tree, text = ast.parse(source), _Text(source)
    top = _scope([s for s in tree.body if isinstance(s, (ast.Assign, ast.AnnAssign))], text)
    everything = list(ast.walk(tree))
    imports = sorted((x for x in everything if isinstance(x, (ast.Import, ast.ImportFrom))), key=lambda x: (x.lineno, x.col_offset))
    modules = [m for x in imports for m in ([a.name for a in x.names] if isinstance(x, ast.Import) else ["." * x.level + (x.module or "")])]
    out = [{"name": None, "class_name": None, "imports": list(dict.fromkeys(modules)), "class_count": sum(isinstance(x, ast.ClassDef) for x in everything),
            "start_line": 1, "end_line": max(1, len(source.splitlines())), "nodes": top, "outer": []}]

    def definitions(n: ast.AST, inside: str | None) -> None:
        for child in ast.iter_child_nodes(n):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                shown, bound = _parameters(child)
                out.append({"name": child.name, "class_name": inside, "is_async": isinstance(child, ast.AsyncFunctionDef), "start_line": child.lineno, "end_line": child.end_lineno,
                            "params": shown, "bound": bound, "nodes": _scope([*child.args.defaults, *filter(None, child.args.kw_defaults), *child.body], text), "outer": top})
            definitions(child, child.name if isinstance(child, ast.ClassDef) else inside)

    definitions(tree, None)
    return out
