"""JavaScript, TypeScript, Go, Rust and C++ by a small lexer and a brace-scope walk.

The walk knows declarations, imports, calls, routes, branches and literals well enough
for the facts; it isn't a compiler's parser, and an unbalanced file is marked so.
"""

from __future__ import annotations

import re

from .model import MODULE, Facts

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>=>|->|::|&&|\|\||\?\?|\?\.|[{}()\[\];,.:?=<>!&|+*/%@#~^-])|(?P<space>\s+)|(?P<other>.)""",
    re.DOTALL,
)
PY_TOKEN = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<string>[rbfuRBFU]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_]\w*)|(?P<op>[^\sA-Za-z_0-9])|(?P<space>\s+)|(?P<other>.)""", re.DOTALL)
KEYWORDS = frozenset("if else for while do switch case default break continue return function class const let var import export from new try catch finally throw async await fn pub mod use impl struct enum trait match loop func type package interface go defer range template typename namespace static public private protected def lambda with yield raise except elif and or not in is None True False".split())
BRANCH = frozenset("if for while case catch match loop select".split())
NEST = frozenset("if for while switch match catch loop select".split())
FUNCTION = {"function", "func", "fn"}
TYPES = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait"}
VERBS = frozenset("all delete get head options patch post put".split())
REQUEST = frozenset("body cookies headers params query".split())
NOT_CALLS = KEYWORDS | {"sizeof", "typeof", "super"}


def tokens(text: str, language: str = "") -> list[tuple[str, int]]:
    """(token, line) with identifiers, numbers and strings in one bucket each and comments dropped, for clone detection."""
    out, line = [], 1
    for m in (PY_TOKEN if language == "python" else TOKEN).finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind not in ("comment", "space"):
            out.append((value if kind == "op" or value in KEYWORDS else {"name": "ID", "number": "NUM", "string": "STR"}.get(kind, value), line))
        line += value.count("\n")
    return out


def lex(text: str) -> list[tuple[str, str, int]]:
    out, line = [], 1
    for m in TOKEN.finditer(text):
        if m.lastgroup not in ("comment", "space"):
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


def imports(text: str, language: str) -> list[tuple[str, str, int, list[str]]]:
    found = []
    at = lambda m: text.count("\n", 0, m.start()) + 1
    if language in ("typescript", "javascript"):
        for m in re.finditer(r"""(?m)(?:^|;)\s*import\s+(type\s+)?(?:([\w$*{}\s,]+?)\s+from\s+)?["']([^"']+)["']""", text):
            names = re.findall(r"[\w$]+(?=\s*(?:,|\}|$|\s+as\b))", (m[2] or "").split("{")[-1]) if m[2] and "{" in m[2] else []
            found.append((m[3], "type_import" if m[1] else "import", at(m), [n for n in names if n not in ("as", "type")]))
        for m in re.finditer(r"""(?m)^\s*export\s+(type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s+["']([^"']+)["']""", text):
            found.append((m[2], "re_export", at(m), []))
        for m in re.finditer(r"""\b(?:require|import)\(\s*["']([^"']+)["']\s*\)""", text):
            found.append((m[1], "dynamic_import" if m[0].startswith("import") else "require", at(m), []))
    elif language == "go":
        for m in re.finditer(r'(?s)\bimport\s*\((.*?)\)|\bimport\s+(?:[\w.]+\s+)?"([^"]+)"', text):
            for spec in re.findall(r'"([^"]+)"', m[1]) if m[1] else [m[2]]:
                found.append((spec, "import", at(m), []))
    elif language == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", text):
            found.append((m[1].rstrip(":"), "import", at(m), []))
        for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", text):
            found.append((f"self::{m[1]}", "import", at(m), []))
    else:
        for m in re.finditer(r'(?m)^\s*#\s*include\s*([<"])([^>"]+)[>"]', text):
            found.append((m[2], "system_include" if m[1] == "<" else "import", at(m), []))
    return found


def exports(text: str) -> list[tuple[str, int, bool, str | None, str | None]]:
    found = []
    at = lambda m: text.count("\n", 0, m.start()) + 1
    for m in re.finditer(r"(?m)^\s*export\s+(?:declare\s+)?(default\s+)?(?:async\s+)?(?:abstract\s+)?(function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)", text):
        found.append(("default" if m[1] else m[3], at(m), m[2] in ("interface", "type"), None, None))
    for m in re.finditer(r"""(?m)^\s*export\s+(type\s+)?\{([^}]*)\}(?:\s*from\s+["']([^"']+)["'])?""", text):
        for item in filter(None, (x.strip() for x in m[2].split(","))):
            old, _, new = item.removeprefix("type ").partition(" as ")
            found.append(((new or old).strip(), at(m), bool(m[1]) or item.startswith("type "), m[3], old.strip() if m[3] else None))
    for m in re.finditer(r"""(?m)^\s*export\s+\*\s*(?:as\s+([\w$]+)\s+)?from\s+["']([^"']+)["']""", text):
        found.append((m[1] or "*", at(m), False, m[2], "*"))
    return found


class Scope:
    def __init__(self, kind: str, name: str, line: int, params: list[str] = ()):
        self.kind, self.name, self.line, self.params = kind, name, line, list(params)
        self.cyclomatic, self.cognitive, self.nest = 1, 0, 0


def _close(toks, i, opener="(", closer=")") -> int:
    """Place after the bracket that closes the one at ``i``."""
    depth = 0
    while i < len(toks):
        depth += (toks[i][1] == opener) - (toks[i][1] == closer)
        i += 1
        if not depth:
            return i
    return i


def _params(toks, i, language) -> list[str]:
    names, depth, end, fresh = [], 0, _close(toks, i), True
    last = None
    for kind, value, _ in toks[i + 1 : end - 1]:
        depth += value in "([{<" and kind == "op"
        depth -= value in ")]}>" and kind == "op"
        if depth == 0 and value == ",":
            if language == "cpp" and last:
                names.append(last)
            fresh, last = True, None
        elif kind == "name" and depth == 0:
            if fresh and language != "cpp" and value not in ("mut", "self", "this", "ref"):
                names.append(value)
                fresh = False
            last = value
    if language == "cpp" and last and last != "void":
        names.append(last)
    return names


def extract(text: str, language: str) -> Facts:
    facts, toks = Facts(), lex(text)
    facts.imports = imports(text, language)
    if language in ("typescript", "javascript"):
        facts.exports = exports(text)
    facts.suppressions(text)
    script = language in ("typescript", "javascript")
    process = any("process" in spec for spec, *_ in facts.imports)
    stack: list[Scope | None] = []
    pending: Scope | None = None
    i = 0

    def named():
        return [s for s in stack if s]

    def here():
        return ".".join(s.name for s in named()) or MODULE

    def function():
        return next((s for s in reversed(stack) if s and s.kind in ("function", "method")), None)

    def value(k):
        return toks[k][1] if 0 <= k < len(toks) else ""

    while i < len(toks):
        kind, v, line = toks[i]
        prev, nxt = value(i - 1), value(i + 1)
        f = function()
        if kind == "name" and v in TYPES and i + 1 < len(toks) and toks[i + 1][0] == "name" and prev not in (".", "enum"):
            pending = Scope(TYPES[v], nxt, line)
            i += 1
        elif language == "go" and v == "type" and value(i + 2) in ("struct", "interface"):
            pending = Scope(value(i + 2), nxt, line)
            i += 2
        elif language == "rust" and v == "impl":
            k = i + 1
            while k < len(toks) and toks[k][1] not in "{;":
                k += 1
            names = [t[1] for t in toks[i + 1 : k] if t[0] == "name"]
            pending = Scope("impl", names[names.index("for") + 1] if "for" in names[:-1] else (names[0] if names else "impl"), line)
            i = k - 1
        elif kind == "name" and v in FUNCTION and not (v == "func" and language != "go"):
            k, owner = i + 1, None
            if language == "go" and value(k) == "(":
                end = _close(toks, k)
                owner = next((t[1] for t in reversed(toks[k:end]) if t[0] == "name"), None)
                k = end
            if value(k) == "*":
                k += 1
            if k < len(toks) and toks[k][0] == "name":
                name = f"{owner}.{value(k)}" if owner else value(k)
                while k < len(toks) and value(k) != "(":
                    k += 1
                inside = bool(named()) and named()[-1].kind in ("class", "impl", "trait", "struct")
                pending = Scope("method" if owner or inside else "function", name, line, _params(toks, k, language))
                i = _close(toks, k) - 1
        elif script and kind == "name" and v not in KEYWORDS and nxt in ("=", ":") and (m := _arrow(toks, i + 2)):
            pending = Scope("function", v, line, _params(toks, m[0], language) if value(m[0]) == "(" else [value(m[0])])
            if value(m[1]) != "{":  # an expression body has no scope of its own
                facts.symbols.append(("function", v, ".".join([*[s.name for s in named()], v]), line, toks[min(m[1], len(toks) - 1)][2], "public"))
                facts.complexity.append((".".join([*[s.name for s in named()], v]), line, 1, 0, 1, len(pending.params), pending.params))
                pending = None
            i = m[1] - 1
        elif kind == "name" and nxt == "(" and (v not in NOT_CALLS or (v == "new" and prev == "::")):
            end = _close(toks, i + 1)
            after = end
            while language == "cpp" and value(after) in ("const", "noexcept", "override", "final"):
                after += 1
            top = stack[-1] if stack else None
            declares = (script and top and top.kind == "class" and value(after) in ("{", ":") and prev not in (".", "=")) or (language == "cpp" and value(after) == "{" and (f is None) and i > 0 and toks[i - 1][0] in ("name", "op") and prev not in (".", "=", "->", "("))
            if declares:
                k = after
                while k < len(toks) and value(k) not in ("{", ";"):
                    k += 1
                pending = Scope("method" if top and top.kind in ("class", "struct") else "function", v, line, _params(toks, i + 1, language))
                i = k - 1
            else:
                receiver = value(i - 2) if prev in (".", "->", "::", "?.") else None
                facts.calls.append((here(), v, receiver, line, False))
                first = toks[i + 2] if i + 2 < len(toks) else ("", "", 0)
                if script and prev == "." and v in VERBS and first[0] == "string" and first[1][1:2] == "/" and value(i + 3) == ",":
                    handler = next((t[1] for t in reversed(toks[i + 4 : end - 1]) if t[0] == "name"), None) if "=>" not in [t[1] for t in toks[i + 4 : end]] else f"<{v.upper()} {first[1][1:-1]} handler>"
                    facts.apis.append((v.upper(), first[1][1:-1], handler, line))
                elif language == "go" and (v == "HandleFunc" or v.lower() in VERBS and v.isupper()) and first[0] == "string":
                    facts.apis.append(("ANY" if v == "HandleFunc" else v, first[1][1:-1], next((t[1] for t in reversed(toks[i + 4 : end - 1]) if t[0] == "name"), None), line))
                rule = _danger(language, v, receiver, process, first[1])
                if rule:
                    facts.security.append((*rule, here(), line))
                if script and (cap := CAPABILITIES.get(v) or CAPABILITIES.get(receiver or "")):
                    facts.capabilities.append((cap, f"{receiver + '.' if receiver else ''}{v}", line))
        elif language == "rust" and v == "#" and nxt == "[" and value(i + 2) in VERBS and value(i + 3) == "(":
            k = i
            while k < len(toks) and value(k) != "fn":
                k += 1
            facts.apis.append((value(i + 2).upper(), value(i + 4)[1:-1], value(k + 1), line))
        elif script and kind == "name" and v in ("req", "request", "ctx") and nxt == "." and value(i + 2) in REQUEST:
            facts.inputs.append((here(), line))
        if kind == "string":
            facts.string(v[1:-1], line, here())
        if f is not None:
            if v in BRANCH and kind == "name" and not (v == "if" and prev == "else" and False):
                f.cyclomatic += 1
            if v in ("&&", "||", "??") or (v == "?" and nxt != "." and script and value(i + 2) == ":" ):
                f.cyclomatic += 1
                f.cognitive += v in ("&&", "||", "??")
            if v in NEST and kind == "name":
                f.cognitive += 1 + f.nest
        if v == "{" and kind == "op":
            if pending:
                pending.open = True
            elif f is not None and any(value(k) in NEST for k in range(max(0, i - 60), i) if _opens(toks, k, i)):
                f.nest += 1
                stack.append(None)
                i += 1
                continue
            stack.append(pending)
            if pending is None and f is not None:
                stack[-1] = None
            pending = None
        elif v == "}" and kind == "op":
            if not stack:
                facts.parse_errors = True
            else:
                s = stack.pop()
                if s is None:
                    g = function()
                    if g is not None and g.nest:
                        g.nest -= 1
                elif s.kind != "impl":
                    qualified = ".".join([*[x.name for x in named()], s.name])
                    facts.symbols.append((s.kind, s.name.rpartition(".")[2], qualified, s.line, line, "public"))
                    if s.kind in ("function", "method"):
                        facts.complexity.append((qualified, s.line, s.cyclomatic, s.cognitive, line - s.line + 1, len(s.params), s.params))
        elif v == ";" and pending:
            pending = None
        i += 1
    facts.parse_errors |= bool(stack)
    return facts


def _opens(toks, k, brace) -> bool:
    """Does the keyword at ``k`` open the block at ``brace``: nothing but its own head between."""
    if toks[k][1] not in NEST:
        return False
    j = k + 1
    if j < len(toks) and toks[j][1] == "(":
        return _close(toks, j) == brace
    return not any(t[1] in "{};" for t in toks[j:brace])


def _arrow(toks, i) -> tuple[int, int] | None:
    """(parameters, body) of an arrow or anonymous function at ``i``."""
    k = i + (i < len(toks) and toks[i][1] == "async")
    if k < len(toks) and toks[k][1] == "function":
        while k < len(toks) and toks[k][1] != "(":
            k += 1
        return k, _close(toks, k)
    if k + 1 < len(toks) and toks[k][0] == "name" and toks[k + 1][1] == "=>":
        return k, k + 2
    if k < len(toks) and toks[k][1] == "(":
        end = _close(toks, k)
        while end < len(toks) and toks[end][1] not in ("=>", "{", ";", ",", ")"):
            end += 1
        if end < len(toks) and toks[end][1] == "=>":
            return k, end + 1
    return None


CAPABILITIES = {"fetch": "network", "axios": "network", "http": "network", "https": "network", "readFile": "filesystem", "writeFile": "filesystem", "readFileSync": "filesystem", "writeFileSync": "filesystem", "fs": "filesystem", "exec": "process", "spawn": "process", "execSync": "process", "setTimeout": "clock", "Date": "clock", "random": "randomness", "localStorage": "storage", "eval": "dynamic-code"}


def _danger(language, name, receiver, process, first) -> tuple[str, str] | None:
    if language in ("typescript", "javascript"):
        if name == "eval":
            return "security/eval", "high"
        if name in ("exec", "execSync") and process or receiver == "child_process":
            return "security/command-exec", "high"
        if name in ("spawn", "spawnSync", "execFile", "execFileSync") and process:
            return "security/command-exec", "medium"
        if name == "createHash" and first[1:-1].lower() in ("md5", "sha1", "sha-1"):
            return "security/weak-hash", "medium"
        if name == "cors" and first == ")":
            return "security/cors", "medium"
    elif language == "go":
        if (receiver, name) in (("exec", "Command"), ("syscall", "Exec")):
            return "security/command-exec", "medium"
        if receiver in ("md5", "sha1") and name in ("New", "Sum"):
            return "security/weak-hash", "medium"
    elif language == "rust":
        if (receiver, name) == ("Command", "new") and process:
            return "security/command-exec", "medium"
        if receiver in ("Md5", "Sha1") or (receiver == "md5" and name == "compute"):
            return "security/weak-hash", "medium"
    elif name in ("system", "popen") or name.startswith("exec") and name in ("execl", "execv", "execvp", "execve", "execlp"):
        return "security/command-exec", "high" if name in ("system", "popen") else "medium"
    elif name in ("MD5", "SHA1"):
        return "security/weak-hash", "medium"
    return None
