"""What the syntax tree of a Python file holds: chunks' entities, calls, types, exceptions, imports (O-33 to O-53, O-59)."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Entity:
    kind: str
    name: str
    parent: str | None
    node: ast.AST
    start: int
    end: int
    doc: str | None
    bases: list[str] = field(default_factory=list)
    params: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    returns: str | None = None
    decorators: list[str] = field(default_factory=list)
    is_async: bool = False
    raises: list[str] = field(default_factory=list)


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def parameters(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> list[tuple[str, str | None, str | None]]:
    """(name with stars, type, default) in order, without self and cls (O-42, O-43)."""
    a = fn.args
    plain = a.posonlyargs + a.args
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(x.arg, x.annotation, d) for x, d in zip(plain, defaults)]
    rows += [("*" + a.vararg.arg, a.vararg.annotation, None)] if a.vararg else []
    rows += [(x.arg, x.annotation, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    rows += [("**" + a.kwarg.arg, a.kwarg.annotation, None)] if a.kwarg else []
    text = lambda n: ast.unparse(n) if n is not None else None
    return [(n, text(t), text(d)) for n, t, d in rows if n not in ("self", "cls")]


def within(node: ast.AST, into_functions: bool = False) -> Iterator[ast.AST]:
    """Nodes below, without those of functions defined inside."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, FUNCTIONS) and not into_functions:
            continue
        yield child
        yield from within(child, into_functions)


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


def raised(fn: ast.AST) -> list[str]:
    """Names of the exceptions raised, sorted (O-45)."""
    out = set()
    for n in within(fn):
        if isinstance(n, ast.Raise) and n.exc is not None:
            x = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
            if name := dotted(x):
                out.add(name)
    return sorted(out)


def called(fn: ast.AST) -> list[str]:
    """Simple names called, each once, in order (O-49, O-50)."""
    out: dict[str, None] = {}
    calls = [n for n in ast.walk(fn) if isinstance(n, ast.Call)]
    for c in sorted(calls, key=lambda n: (n.lineno, n.col_offset)):
        name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
        if name:
            out.setdefault(name)
    return list(out)


def _start(node: ast.AST) -> int:
    return node.lineno


def function(node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> Entity:
    return Entity(
        "method" if parent else "function", node.name, parent, node, _start(node), node.end_lineno or node.lineno, ast.get_docstring(node), params=parameters(node), returns=ast.unparse(node.returns) if node.returns else None,
        decorators=["@" + ast.unparse(d) for d in node.decorator_list], is_async=isinstance(node, ast.AsyncFunctionDef), raises=raised(node),
    )


def entities(tree: ast.Module) -> Iterator[Entity]:
    """Classes with their methods, functions outside classes, nested ones too, in the order of the text."""

    def walk(node: ast.AST, cls: str | None) -> Iterator[Entity]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                bases = [b.id for b in child.bases if isinstance(b, ast.Name)]
                yield Entity("class", child.name, None, child, child.lineno, child.end_lineno or child.lineno, ast.get_docstring(child), bases=bases, decorators=["@" + ast.unparse(d) for d in child.decorator_list])
                yield from walk(child, child.name)
            elif isinstance(child, FUNCTIONS):
                yield function(child, cls)
                yield from walk(child, cls)
            else:
                yield from walk(child, cls)

    yield from walk(tree, None)


def imports(tree: ast.Module) -> list[tuple[int, str]]:
    """(line, module), one per module named."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(n.lineno, a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.append((n.lineno, "." * n.level + (n.module or "")))
    return sorted(out)


def tests(tree: ast.Module) -> Iterator[tuple[str | None, ast.AST]]:
    """Test functions, with their class where that is a Test class (O-59)."""
    for e in entities(tree):
        if e.kind in ("function", "method") and e.name.startswith("test_") and (e.parent is None or e.parent.startswith("Test")):
            yield e.parent, e.node
