import json

import pytest

from lodestar.plans import commands
from lodestar.plans.index import dead_exports, dead_files, findings, index, taint
from lodestar.sinks import tables as K

FILES = {
    "src/billing/api.ts": 'import { total } from "../cart/total";\nimport axios from "axios";\nimport { gone } from "./missing";\nexport function bill(x) { return total(x); }\n',
    "src/cart/total.ts": 'import type { Bill } from "../billing/types";\nexport function total(x) { if (x && x.y) { for (const i of x) { add(i); } } return 1; }\nexport function unused() { return 2; }\n',
    "src/billing/types.ts": "export interface Bill { a: number }\nexport type Never = string;\n",
    "src/index.ts": 'import { bill } from "./billing/api";\nconst save = async (req, res) => { const b = req.body; bill(b); db.query("INSERT INTO orders VALUES (1)"); };\nrouter.post("/orders", save);\n',
    "src/orphan.ts": "export const lonely = 1;\n",
    "src/named.ts": 'export const loaded = "by a string";\n',
    "src/load.test.ts": 'const x = "./named.ts";\n',
    "py/app/main.py": 'from .jobs import run\nimport hashlib\n\ndef go():\n    run()\n    return hashlib.md5(b"x")\n',
    "py/app/jobs.py": "import os\n\ndef run():\n    # lodestar-ignore\n    os.system('ls')\n\n# lodestar-ignore\nX = 1\n",
    "node_modules/dep/index.js": "module.exports = 1\n",
    "ignored/x.ts": "export const no = 1\n",
    ".gitignore": "ignored/\n",
}


@pytest.fixture(scope="module")
def ix(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return index(spark, str(root))


def test_files(ix):
    assert {r["path"] for r in ix.files.collect()} == {f for f in FILES if f.endswith((".ts", ".py")) and not f.startswith(("ignored", "node_modules"))}


def test_imports_resolve(ix):
    got = {(r["source_file_path"], r["specifier"]): (r["target_file_path"], r["target_module"]) for r in ix.dependencies.collect()}
    assert got["src/billing/api.ts", "../cart/total"] == ("src/cart/total.ts", "cart")
    assert got["src/billing/api.ts", "axios"] == (None, "external:axios")
    assert got["src/billing/api.ts", "./missing"] == (None, "unresolved:./missing")
    assert got["py/app/main.py", ".jobs"][0] == "py/app/jobs.py"


def test_calls_and_taint(ix):
    names = {r["id"]: r["qualified_name"] for r in ix.symbols.collect()}
    got = {(r["caller"], names.get(r["callee_symbol_id"])) for r in ix.calls.collect()}
    assert {("bill", "total"), ("save", "bill"), ("go", "run")} <= got
    (flow,) = taint(ix).collect()
    assert (flow["label"], flow["kind"], flow["tainted"], flow["severity"]) == ("orders", "writes", True, "high")


def test_dead_code(ix):
    got = {r["node"]: r["rule_name"] for r in dead_files(ix).collect()}
    assert got == {"src/orphan.ts": "unused-file", "src/named.ts": "possibly-unused-file"}
    names = {(r["file"], r["name"]): r["rule_name"] for r in dead_exports(ix).collect()}
    assert names["src/cart/total.ts", "unused"] == "unused-export" and names["src/billing/types.ts", "Never"] == "unused-type"
    assert ("src/cart/total.ts", "total") not in names and ("src/billing/types.ts", "Bill") not in names


def test_findings_suppressions_and_exports(ix):
    rows = findings(ix).collect()
    rules = {(r["rule_name"], r["file_path"]) for r in rows}
    assert ("security/weak-hash", "py/app/main.py") in rules and ("unresolved-import", "src/billing/api.ts") in rules
    assert ("security/command-exec", "py/app/jobs.py") not in rules and ("stale-suppression", "py/app/jobs.py") in rules
    assert len(json.loads(K.sarif(findings(ix)))["runs"][0]["results"]) == len(rows) == len(json.loads(K.code_climate(findings(ix))))


def test_queries(ix):
    assert {r["node"] for r in commands.run(ix, "rdeps src/cart/total.ts").collect()} == {"src/billing/api.ts"}
    assert "src/cart/total.ts" in {r["node"] for r in commands.run(ix, "deps src/billing/api.ts").collect()}
    assert commands.run(ix, "src/index.ts -> src/cart/total.ts").count() == 1
    assert commands.run(ix, "cycles").count() == 0  # the way back is a type import
    assert commands.summary(ix).first()["modules"] == 4
    assert commands.impact(ix, "src/cart/total.ts").first()["risk"] == "low"
    with pytest.raises(LookupError, match="did you mean"):
        commands.run(ix, "rdeps src/cart/totol.ts")
    with pytest.raises(ValueError):
        commands.parse("cycles x")


def test_cache_gives_the_same(spark, ix, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    again = index(spark, str(tmp_path), cache=ix.facts)
    assert sorted(again.facts.select("path", "content_hash").collect()) == sorted(ix.facts.select("path", "content_hash").collect())


def test_export_graph(ix):
    g = K.graph_export(ix.dependencies, ix.files)
    assert ("billing", "cart") in {tuple(r) for r in g["modules"].collect()}
    assert "<script>" not in K.graph_html([("<script>", "b")], "t").split("<ul>")[1]
