"""What an extractor gives for one file, before anything is resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LISTS = {
    "symbols": "kind string, name string, qualified_name string, start_line int, end_line int, visibility string",
    "imports": "specifier string, kind string, line int, names array<string>",
    "calls": "caller string, callee string, receiver string, line int, is_reference boolean",
    "apis": "method string, path string, handler string, line int",
    "schema_refs": "symbol string, table string, access string, line int",
    "security": "rule string, severity string, symbol string, line int",
    "suppressed": "line int",
    "complexity": "qualified_name string, line int, cyclomatic int, cognitive int, line_count int, param_count int, params array<string>",
    "exports": "name string, line int, is_type_only boolean, re_export_source string, re_export_name string",
    "capabilities": "capability string, api string, line int",
    "inputs": "symbol string, line int",
    "literals": "value string",
}
DDL = "path string, content_hash string, parse_errors boolean, " + ", ".join(f"{k} array<struct<{v.replace(' array', ':array').replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>" for k, v in LISTS.items())
NAMES = {k: [c.strip().split(" ")[0] for c in v.split(",")] for k, v in LISTS.items()}
SUPPRESS = re.compile(r"^\s*(?:#|//|/\*|--)\s*lodestar-ignore\b")
PROVIDER = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
FILLER = re.compile(r"(?i)example|dummy|placeholder|changeme|your[_-]|xxxx")
PATH_LITERAL = re.compile(r"^[\w@.~/-]*/[\w@.-]+\.[A-Za-z0-9]{1,4}$|^[\w.-]+\.(?:[cm]?[jt]sx?|py|go|rs|html|ya?ml|json)$")
SQL = re.compile(r"(?is)\b(?:(select)\b.*?\bfrom|(insert)\s+into|(update)|(delete)\s+from|(create)\s+table(?:\s+if\s+not\s+exists)?|(alter)\s+table|(truncate)(?:\s+table)?)\s+[\"`]?([a-z_][\w.]*)")
MODULE = "<module>"


@dataclass
class Facts:
    """The lists of one file; rows are tuples in the order of LISTS."""

    parse_errors: bool = False
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    apis: list = field(default_factory=list)
    schema_refs: list = field(default_factory=list)
    security: list = field(default_factory=list)
    suppressed: list = field(default_factory=list)
    complexity: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    capabilities: list = field(default_factory=list)
    inputs: list = field(default_factory=list)
    literals: list = field(default_factory=list)

    def string(self, value: str, line: int, symbol: str) -> None:
        """What any string literal may tell: a provider's key, a statement, a file's path."""
        if (m := PROVIDER.search(value)) and not FILLER.search(m[0]):
            self.security.append(("security/secret", "critical", symbol, line))
        if len(value) < 10_000 and (m := SQL.search(value)):
            self.schema_refs.append((symbol, m[8].lower(), "reads" if m[1] else "writes", line))
        if len(value) <= 256 and len(self.literals) < 64 and PATH_LITERAL.match(value) and (value,) not in self.literals:
            self.literals.append((value,))

    def suppressions(self, text: str) -> None:
        self.suppressed += [(i,) for i, line in enumerate(text.splitlines(), 1) if SUPPRESS.match(line)]
