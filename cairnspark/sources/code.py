"""Source files to graph facts: nodes, contains edges, references and imports.

Python is read by its own grammar. GraphQL, Java, Go and TypeScript are read by patterns over the text, with
comments and strings blanked: declarations, inheritance, calls and imports as they are usually written. That
is an approximation: constructs that need a grammar (generics across lines, nested lambdas) may be missed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "path string, language string, status string, package string, imports array<string>, nodes array<struct<id:string,kind:string,name:string,line:int,end_line:int,params:string,return_type:string,exported:boolean>>, refs array<struct<from_id:string,kind:string,name:string,line:int,recv:string>>, contains array<struct<from_id:string,to_id:string>>"
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".graphql": "graphql", ".gql": "graphql"}


class _Facts:
    def __init__(self, path: str, language: str) -> None:
        self.path, self.language, self.package, self.imports = path, language, "", []
        self.nodes, self.refs, self.contains = [], [], []
        self.node(path, "file", path.rsplit("/", 1)[-1], 0, 0)

    def node(self, id_: str, kind: str, name: str, line: int, end: int, params: str = "", returns: str = "", exported: bool = True, parent: str | None = None) -> str:
        self.nodes.append((id_, kind, name, line, end, " ".join(params.split()), returns, exported))
        if parent:
            self.contains.append((parent, id_))
        return id_

    def ref(self, from_id: str, kind: str, name: str, line: int, recv: str = "") -> None:
        if (from_id, kind, name, line, recv) not in self.refs[-50:]:
            self.refs.append((from_id, kind, name, line, recv))


def _dotted(e: ast.expr) -> str:
    return ast.unparse(e) if isinstance(e, (ast.Name, ast.Attribute)) else ""


def parse_python(path: str, text: str) -> _Facts:
    f = _Facts(path, "python")
    f.package = path.rpartition("/")[0].replace("/", ".")
    tree = ast.parse(text)

    def calls(owner: str, body: ast.AST) -> None:
        for n in ast.walk(body):
            if isinstance(n, ast.Call) and (name := _dotted(n.func)):
                recv, _, last = name.rpartition(".")
                f.ref(owner, "calls", last, n.lineno, recv)

    def visit(body: list[ast.stmt], parent: str, prefix: str) -> None:
        for n in body:
            if isinstance(n, ast.Import):
                f.imports += [a.name for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                f.imports += [f"{base}.{a.name}".lstrip(".") if a.name != "*" else base + ".*" for a in n.names]
            elif isinstance(n, ast.ClassDef):
                name = prefix + n.name
                test = n.name.startswith("Test") or any(_dotted(b).endswith("TestCase") for b in n.bases)
                me = f.node(f"{path}::{name}", "test" if test else "class", name, n.lineno, n.end_lineno, exported=not n.name.startswith("_"), parent=parent)
                for b in n.bases:
                    if base := _dotted(b):
                        f.ref(me, "extends", base.rpartition(".")[2], n.lineno)
                visit(n.body, me, name + ".")
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = prefix + n.name
                kind = "test" if n.name.startswith("test_") and not prefix else "function"
                me = f.node(f"{path}::{name}", kind, name, n.lineno, n.end_lineno, f"({ast.unparse(n.args)})", ast.unparse(n.returns) if n.returns else "", not n.name.startswith("_"), parent)
                calls(me, n)

    visit(tree.body, path, "")
    return f


def _blank(text: str, line_comment: str) -> str:
    """Comments and strings as blanks, lines kept."""
    token = re.compile(rf"/\*.*?\*/|{line_comment}[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(text: str, at: int) -> int:
    """Place of the brace that closes the first one after `at`, or `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return m.start()
    return at


_CALL = re.compile(r"(?:([A-Za-z_$][\w$.]*)\.)?([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return new function super this throw typeof await import require synchronized else do".split())
_NOT_GO_CALLS = frozenset("if for switch return func go defer select range case".split())


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _calls(f: _Facts, owner: str, text: str, start: int, end: int) -> None:
    for m in _CALL.finditer(text, start, end):
        if m[2] not in (_NOT_GO_CALLS if f.language == "go" else _NOT_CALLS):
            f.ref(owner, "calls", m[2], _line(text, m.start()), m[1] or "")


def _names(text: str) -> list[str]:
    return [x for part in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", text).split(",") if (x := part.strip().rpartition(".")[2])]


def parse_java(path: str, text: str) -> _Facts:
    f = _Facts(path, "java")
    code = _blank(text, "//")
    if m := re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M):
        f.package = m[1]
    f.imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M)
    kind = re.compile(r"((?:\b(?:public|private|protected|abstract|final|static|sealed)\s+)*)\b(?:class|interface|enum|record|@interface)\s+(\w+)\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?:extends\s+([\w.<>,\s?&]+?))?\s*(?:implements\s+([\w.<>,\s?&]+?))?\s*\{")
    method = re.compile(r"((?:\b(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s+)?([\w.<>\[\],?]+)\s+(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w.,\s]+)?\s*[{;]")
    types = [(m, _end(code, m.end() - 1)) for m in kind.finditer(code)]
    for m, end in types:
        test = m[2].startswith("Test") or re.search(r"(?:Test|Tests|IT)$", m[2])
        me = f.node(f"{path}::{m[2]}", "test" if test else "class", m[2], _line(code, m.start()), _line(code, end), exported="private" not in m[1], parent=path)
        is_interface = "interface" in m[0]
        for name in _names(m[3] or ""):
            f.ref(me, "extends", name, _line(code, m.start()))
        for name in _names(m[4] or ""):
            f.ref(me, "extends" if is_interface else "implements", name, _line(code, m.start()))
        inner = [(a.start(), z) for a, z in types if m.end() <= a.start() and z < end]
        for d in method.finditer(code, m.end(), end):
            if d[2] in ("return", "new", "throw", "else") or d[3] in _NOT_CALLS or any(a <= d.start() <= z for a, z in inner):
                continue
            stop = _end(code, d.end() - 1) if d[0].endswith("{") else d.end()
            fn = f.node(f"{path}::{m[2]}.{d[3]}", "function", f"{m[2]}.{d[3]}", _line(code, d.start(2)), _line(code, stop), f"({d[4]})", d[2], "private" not in d[1] and (is_interface or "public" in d[1]), me)
            _calls(f, fn, code, d.end(), stop)
    return f


def parse_go(path: str, text: str) -> _Facts:
    f = _Facts(path, "go")
    f.package = path.rpartition("/")[0]
    for block in re.findall(r"^import\s*\(([^)]*)\)", text, re.M) + re.findall(r"^import\s+(?:\w+\s+)?(\"[^\"]+\")", text, re.M):
        f.imports += re.findall(r"\"([^\"]+)\"", block)
    code = _blank(text, "//")
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{", code, re.M):
        end = _end(code, m.end() - 1)
        me = f.node(f"{path}::{m[1]}", "class", m[1], _line(code, m.start()), _line(code, end), exported=m[1][0].isupper(), parent=path)
        for name in re.findall(r"^\s+\*?(?:\w+\.)?([A-Z]\w*)\s*$", code[m.end() : end], re.M):
            f.ref(me, "extends", name, _line(code, m.start()))
    for m in re.finditer(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)(?:\[[^\]]*\])?\s*(\([^{]*?\))\s*([^{\n]*)\{", code, re.M):
        end = _end(code, m.end() - 1)
        name = f"{m[1]}.{m[2]}" if m[1] else m[2]
        kind = "test" if path.endswith("_test.go") and m[2].startswith("Test") else "function"
        fn = f.node(f"{path}::{name}", kind, name, _line(code, m.start()), _line(code, end), m[3], m[4].strip(), m[2][0].isupper(), f"{path}::{m[1]}" if m[1] else path)
        _calls(f, fn, code, m.end(), end)
    return f


def parse_typescript(path: str, text: str) -> _Facts:
    f = _Facts(path, "typescript")
    f.package = path.rpartition("/")[0]
    f.imports = re.findall(r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]", text)
    code = _blank(text, "//")
    for m in re.finditer(r"(\bexport\s+(?:default\s+)?)?(?:abstract\s+)?\b(?:class|interface)\s+(\w+)(?:<[^{]*?>)?\s*(?:extends\s+([\w.<>,\s]+?))?\s*(?:implements\s+([\w.<>,\s]+?))?\s*\{", code):
        end = _end(code, m.end() - 1)
        me = f.node(f"{path}::{m[2]}", "class", m[2], _line(code, m.start()), _line(code, end), exported=bool(m[1]), parent=path)
        for k, part in (("extends", m[3]), ("implements", m[4])):
            for name in _names(part or ""):
                f.ref(me, k, name, _line(code, m.start()))
        for d in re.finditer(r"^\s*((?:public|private|protected|static|async|readonly|override)\s+)*(\w+)\s*(?:<[^>]*>)?\(([^()]*)\)\s*(?::\s*([^{;\n]+))?\s*\{", code[m.end() : end], re.M):
            if d[2] in _NOT_CALLS:
                continue
            s = m.end() + d.start()
            stop = _end(code, m.end() + d.end() - 1)
            fn = f.node(f"{path}::{m[2]}.{d[2]}", "function", f"{m[2]}.{d[2]}", _line(code, m.end() + d.start(2)), _line(code, stop), f"({d[3]})", (d[4] or "").strip(), "private" not in (d[1] or ""), me)
            _calls(f, fn, code, s + len(d[0]), stop)
    for m in re.finditer(r"^(export\s+(?:default\s+)?)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?(\([^{]*?\))\s*(?::\s*([^{]+?))?\s*\{|^(export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(\([^)]*\)|\w+)\s*(?::\s*([^=]+?))?\s*=>", code, re.M):
        name = m[2] or m[6]
        end = _end(code, m.end() - 1 if m[2] else m.end())
        fn = f.node(f"{path}::{name}", "function", name, _line(code, m.start()), _line(code, end), m[3] or m[7] or "", (m[4] or m[8] or "").strip(), bool(m[1] or m[5]), path)
        _calls(f, fn, code, m.end(), end)
    return f


def parse_graphql(path: str, text: str) -> _Facts:
    f = _Facts(path, "graphql")
    code = re.sub(r"#[^\n]*|\"\"\".*?\"\"\"", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"\b(query|mutation|subscription|fragment|type|interface|input|enum|union|scalar)\s+(\w+)(?:\s+on\s+(\w+))?", code):
        kind = "graphql_fragment" if m[1] == "fragment" else "graphql_operation" if m[1] in ("query", "mutation", "subscription") else "graphql_type"
        end = _end(code, m.end()) if "{" in code[m.end() : m.end() + 200] else m.end()
        me = f.node(f"{path}::gql::{m[2]}", kind, m[2], _line(code, m.start()), _line(code, end), returns=m[3] or "", parent=path)
        for s in re.finditer(r"\.\.\.\s*(?!on\b)(\w+)", code[m.end() : end]):
            f.ref(me, "spreads", s[1], _line(code, m.end() + s.start()))
    return f


PARSERS = {"python": parse_python, "java": parse_java, "go": parse_go, "typescript": parse_typescript, "graphql": parse_graphql}


def parse(path: str, text: str) -> tuple:
    """A row of FACTS. A file that can't be read has status failed and its file node alone."""
    language = LANGUAGES.get("." + path.rsplit(".", 1)[-1], "")
    try:
        f, status = PARSERS[language](path, text), "ok"
    except (SyntaxError, ValueError, RecursionError, KeyError):
        f, status = _Facts(path, language), "failed"
    return path, language, status, f.package, f.imports, f.nodes, f.refs, f.contains


def parse_files(files: DataFrame) -> DataFrame:
    """FACTS of source files (path, content binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "language", "status", "package", "imports", "nodes", "refs", "contains"]
        fields = {"nodes": ("id", "kind", "name", "line", "end_line", "params", "return_type", "exported"), "refs": ("from_id", "kind", "name", "line", "recv"), "contains": ("from_id", "to_id")}
        for g in batches:
            rows = [parse(p, c.decode(errors="replace")) for p, c in zip(g["path"], g["content"])]
            out = pd.DataFrame(rows, columns=names)
            for c, keys in fields.items():
                out[c] = [[dict(zip(keys, x)) for x in v] for v in out[c]]
            yield out

    return files.select("path", "content").mapInPandas(run, FACTS)


def tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, contains edges, refs and files of FACTS. Of equal node ids in a file the first stays."""
    nodes = facts.select("path", "language", F.posexplode("nodes").alias("n", "x")).select("x.*", "path", "language", "n")
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c not in ("id", "n")]), "n").alias("x")).select("id", "x.*")
    contains = facts.select(F.inline("contains")).distinct().select("from_id", "to_id", F.lit("contains").alias("kind"), F.lit("exact").alias("confidence"))
    return first, contains, facts.select(F.inline("refs")), facts.select("path", "language", "status", "package", "imports")
