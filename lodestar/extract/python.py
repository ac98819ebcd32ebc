"""Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .model import MODULE, Facts

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)
CALLABLES = (ast.FunctionDef, ast.AsyncFunctionDef)
VERBS = frozenset("delete get head options patch post put route".split())
SHELL = {"os.system", "os.popen"}


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def complexity(body: ast.AST) -> tuple[int, int]:
    """(cyclomatic, cognitive); nested callables count for themselves."""
    cyclomatic, cognitive = 1, 0

    def walk(node, depth):
        nonlocal cyclomatic, cognitive
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (*CALLABLES, ast.Lambda, ast.ClassDef)):
                continue
            if isinstance(child, BRANCHES):
                cyclomatic += 1
            if isinstance(child, ast.BoolOp):
                cyclomatic += len(child.values) - 1
                cognitive += 1
            if isinstance(child, ast.comprehension):
                cyclomatic += 1 + len(child.ifs)
            nested = isinstance(child, NESTING)
            if nested:
                cognitive += 1 + depth
            walk(child, depth + nested)

    walk(body, 0)
    return cyclomatic, cognitive


class Extractor(ast.NodeVisitor):
    def __init__(self):
        self.facts, self.scope, self.imported = Facts(), [], {}

    @property
    def here(self) -> str:
        return ".".join(self.scope) or MODULE

    def visit_Import(self, node):
        for a in node.names:
            self.facts.imports.append((a.name, "import", node.lineno, []))
            self.imported[a.asname or a.name.split(".")[0]] = a.name

    def visit_ImportFrom(self, node):
        self.facts.imports.append(("." * node.level + (node.module or ""), "import", node.lineno, [a.name for a in node.names]))

    def visit_ClassDef(self, node):
        name = ".".join([*self.scope, node.name])
        self.facts.symbols.append(("class", node.name, name, node.lineno, node.end_lineno, "private" if node.name.startswith("_") else "public"))
        self._inside(node)

    def _function(self, node):
        name = ".".join([*self.scope, node.name])
        method = bool(self.scope) and self.scope[-1][:1].isupper()
        self.facts.symbols.append(("method" if method else "function", node.name, name, node.lineno, node.end_lineno, "private" if node.name.startswith("_") else "public"))
        params = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg not in ("self", "cls")]
        cyclomatic, cognitive = complexity(node)
        self.facts.complexity.append((name, node.lineno, cyclomatic, cognitive, node.end_lineno - node.lineno + 1, len(params), params))
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS and d.args and isinstance(d.args[0], ast.Constant):
                verbs = [d.func.attr.upper()]
                if d.func.attr == "route":
                    listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    verbs = [e.value for e in listed.elts if isinstance(e, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
                self.facts.apis += [(v, str(d.args[0].value), name, d.lineno) for v in verbs]
        self._inside(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _inside(self, node):
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_Call(self, node):
        name = dotted(node.func)
        receiver, _, leaf = name.rpartition(".")
        if leaf:
            self.facts.calls.append((self.here, leaf, receiver or None, node.lineno, False))
        full = f"{self.imported.get(receiver.split('.')[0], receiver)}.{leaf}" if receiver else leaf
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        if name in ("eval", "exec"):
            self.facts.security.append(("security/eval", "high", self.here, node.lineno))
        elif full in SHELL or full.startswith(("subprocess.", "os.exec", "os.spawn")):
            self.facts.security.append(("security/command-exec", "high" if shell or full in SHELL else "medium", self.here, node.lineno))
        elif full in ("hashlib.md5", "hashlib.sha1"):
            self.facts.security.append(("security/weak-hash", "medium", self.here, node.lineno))
        for arg in [*node.args, *(k.value for k in node.keywords)]:
            if isinstance(arg, ast.Name):
                self.facts.calls.append((self.here, arg.id, None, arg.lineno, True))
        self.generic_visit(node)

    def visit_Constant(self, node):
        if isinstance(node.value, str):
            self.facts.string(node.value, node.lineno, self.here)


def extract(text: str) -> Facts:
    e = Extractor()
    try:
        e.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError):
        e.facts = Facts(parse_errors=True)
    e.facts.suppressions(text)
    return e.facts


def tokens(text: str) -> list[tuple[str, int]]:
    from .lexer import tokens as general

    return general(text, "python")
