"""Source text to FUNCSIG rows: Python by its own grammar, Go by ours, JSON shapes, SQL schemas, script parts of components."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftlens.functions import constants as K
from driftlens.schema import FUNCSIG
from driftlens.sources import go_signals

ROOTS = frozenset("_engine _impl _inner _delegate _wrapped _backend _real _target".split())
_CONST = re.compile(r"[A-Z][A-Z0-9_]{2,}\Z")
SQL_HEAD = re.compile(r"""create\s+table\s+(?:if\s+not\s+exists\s+)?[`"']?([a-z_][a-z0-9_.]*)[`"']?\s*\(""", re.I)
_PARENTHESIS, _CUTS, _COLUMN, _EXTENSION = re.compile("[()]"), re.compile("[(),]"), re.compile(r"""\s*[`"']*(\w+)""", re.ASCII), re.compile(r"\.[^.]*\Z")
SQL_BEARING = [".sql", ".py", ".go", ".ts", ".tsx", ".js", ".rb"]


_ZERO = {f.name: {"array": [], "map": {}, "integer": 0, "boolean": False}.get(f.dataType.typeName(), "") for f in FUNCSIG}
BATCH = 2000  # rows that go back to Spark at once


def _row(**given) -> dict:
    return {k: [] if v == [] else {} if v == {} else v for k, v in _ZERO.items()} | given


def _path(node: ast.AST) -> str:
    """Dotted attributes without the name they hang on; '' if they hang on something else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed(parts)) if isinstance(node, ast.Name) else ""


def _targets(node: ast.AST) -> Iterator[ast.AST]:
    if isinstance(node, (ast.Tuple, ast.List)):
        for e in node.elts:
            yield from _targets(e)
    else:
        yield node


class _Body:
    """What a function's body touches."""

    def __init__(self, body: list[ast.stmt]):
        self.strings, self.writes, self.reads, self.keys, self.calls, self.consts = (set() for _ in range(6))
        self.delegates, self.nodes = False, 0
        callees = set()
        nodes = list(chain.from_iterable(map(ast.walk, body)))
        self.nodes = len(nodes)
        for node in nodes:
            if type(node) is ast.Call:
                self._call(node, callees)
        for node in nodes:
            if type(node) in _LOOKED_AT:
                self._look(node, callees)

    def _call(self, node: ast.Call, callees: set[int]) -> None:
        if isinstance(node.func, ast.Attribute):
            self.calls.add(node.func.attr)
            callees.add(id(node.func))
            if _path(node.func).split(".")[0] in ROOTS:
                self.delegates = True
        elif isinstance(node.func, ast.Name):
            self.calls.add(node.func.id)

    def _written(self, target: ast.AST) -> None:
        for t in _targets(target):
            if isinstance(t, ast.Attribute) and (p := _path(t)):
                self.writes.add(p)
            elif isinstance(t, ast.Subscript) and (p := _path(t.value)):
                self.writes.add(p + "[]")

    def _look(self, node: ast.AST, callees: set[int]) -> None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value.strip()) >= 4:
            self.strings.add(node.value.strip())
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            if id(node) not in callees and (p := _path(node)):
                self.reads.add(p)
            if _CONST.match(node.attr):
                self.consts.add(node.attr)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and _CONST.match(node.id):
            self.consts.add(node.id)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                self._written(t)
        elif isinstance(node, (ast.AnnAssign, ast.AugAssign)):
            self._written(node.target)
            if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Attribute) and (p := _path(node.target)):
                self.reads.add(p)
        elif isinstance(node, ast.Return) and isinstance(node.value, ast.Dict):
            self.keys |= {k.value for k in node.value.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)}


_LOOKED_AT = frozenset([ast.Constant, ast.Attribute, ast.Name, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Return])


def _annotation(a: ast.expr | None) -> str:
    return "?" if a is None else ast.unparse(a)


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    plain = [*a.posonlyargs, *a.args]
    if plain and plain[0].arg in ("self", "cls"):
        plain = plain[1:]
    everything = [*plain, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]
    return f"({','.join(_annotation(x.annotation) for x in everything)})=>{_annotation(f.returns)}"


def _module(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _assigned(node: ast.stmt) -> tuple[list[str], ast.expr | None]:
    if isinstance(node, ast.Assign):
        return [t.id for t in node.targets if isinstance(t, ast.Name)], node.value
    if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
        return [node.target.id], node.value
    return [], None


def python_functions(file: str, text: str) -> list[dict]:
    tree = _module(text)
    if tree is None:
        return []
    declared = sorted({n for s in tree.body for n in _assigned(s)[0] if _CONST.match(n)})
    out = []

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, f"{prefix}{child.name}.")
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                b = _Body(child.body)
                last = child.end_lineno or child.lineno
                out.append(
                    _row(
                        file=file, qualname=prefix + child.name, name=child.name, line=child.lineno, n_lines=last - child.lineno + 1, node_count=b.nodes, strings=sorted(b.strings),
                        writes=sorted(b.writes), reads=sorted(b.reads), ret_keys=sorted(b.keys), calls=sorted(b.calls), consts=sorted(b.consts), decl_consts=declared, delegates=b.delegates, sig=_signature(child),
                    )
                )

    visit(tree, "")
    return out


def python_tables(file: str, text: str, least: int = 3, most: int = 400) -> list[dict]:
    tree = _module(text)
    out = []
    for node in tree.body if tree else ():
        names, value = _assigned(node)
        literal = lambda e: isinstance(e, ast.Constant) and isinstance(e.value, str)
        if isinstance(value, ast.Dict):
            keys = [k.value for k in value.keys if literal(k)]
            values = [v.value for k, v in zip(value.keys, value.values) if literal(k) and literal(v)]
        elif isinstance(value, (ast.Set, ast.List, ast.Tuple)):
            keys, values = [e.value for e in value.elts if literal(e)], []
        else:
            continue
        for name in names if keys else ():
            if name.isupper() or len(keys) >= least:
                out.append(_row(file=file, qualname=name, name=name, kind="table", line=node.lineno, n_lines=(node.end_lineno or node.lineno) - node.lineno + 1, strings=sorted(set(values))[:most], ret_keys=sorted(set(keys))[:most]))
    return out


def _shapes(file: str, text: str, depth: int, per_file: int, most_keys: int) -> list[tuple[str, tuple[str, ...], dict]]:
    """(name, keys, object) of each object of two fields or more."""
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return []
    stem = _EXTENSION.sub("", file.rsplit("/", 1)[-1])
    out: list[tuple[str, tuple[str, ...], dict]] = []

    def visit(v, label: str, level: int) -> None:
        if level > depth or len(out) >= per_file:
            return
        if isinstance(v, dict):
            if len(v) >= 2:
                out.append((f"{stem}.{label}" if label else stem, tuple(sorted(v)[:most_keys]), v))
            for k, x in v.items():
                visit(x, k, level + 1)
        elif isinstance(v, list):
            for x in v:
                visit(x, label, level + 1)

    visit(data, "", 0)
    return out


def _shape_row(file: str, name: str, keys: tuple[str, ...], v: dict) -> dict:
    return _row(file=file, qualname=name, name=name, kind="corpus-field", line=1, n_lines=1, ret_keys=list(keys), source=json.dumps(v, indent=2)[:4000])


def json_shapes(file: str, text: str, depth: int = 6, per_file: int = 200, most_keys: int = 400) -> list[dict]:
    """A row for each object of two fields or more."""
    return [_shape_row(file, *s) for s in _shapes(file, text, depth, per_file, most_keys)]


def first_shapes(pairs: Iterable[tuple[str, str]], depth: int = 6, per_file: int = 200, most_keys: int = 400) -> list[dict]:
    """Of the rows of json_shapes over (file, text) the first by file and name of each key set; only those are written out."""
    first: dict[tuple[str, ...], tuple[str, str, dict]] = {}
    for file, text in pairs:
        for name, keys, v in _shapes(file, text, depth, per_file, most_keys):
            had = first.get(keys)
            if had is None or (file, name) < had[:2]:
                first[keys] = (file, name, v)
    return [_shape_row(file, name, keys, v) for keys, (file, name, v) in first.items()]


def _parenthesised(text: str, at: int) -> tuple[str, int] | None:
    level = 0
    for m in _PARENTHESIS.finditer(text, at):
        level += 1 if m[0] == "(" else -1
        if level == 0:
            return text[at + 1 : m.start()], m.start()
    return None


def _columns(body: str, most: int = 200) -> list[str]:
    body = re.sub(r"--[^\n]*", "", re.sub(r"/\*.*?\*/", "", body, flags=re.S)) + ","
    names, level, at = [], 0, 0
    for cut in _CUTS.finditer(body):
        if cut[0] != ",":
            level += 1 if cut[0] == "(" else -1
        elif level == 0:
            m = _COLUMN.match(body, at, cut.start())
            if m and m[1].upper() not in K.CONSTRAINT_LEADERS:
                names.append(m[1])
            at = cut.end()
    return sorted(set(names[:most]))


def sql_tables(file: str, text: str) -> list[dict]:
    out = []
    for m in SQL_HEAD.finditer(text):
        inside = _parenthesised(text, m.end() - 1)
        if inside and len(cols := _columns(inside[0])) >= 2:
            out.append(_row(file=file, qualname=m[1], name=m[1], kind="sql-table", line=1 + text.count("\n", 0, m.start()), n_lines=1, ret_keys=cols, source=text[m.start() : inside[1] + 1][:4000]))
    return out


def script_parts(text: str) -> str:
    """A component with everything outside its script tags blanked; lines stay where they are."""
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    for m in re.finditer(r"""(<script\b(?:[^>"']|"[^"]*"|'[^']*')*>)(.*?)(</script\s*>)""", text, re.S | re.I):
        out += [blank(text[at : m.start(2)]), m[2]]
        at = m.end(2)
    return "".join(out) + blank(text[at:])


EXTRACTORS = {".py": python_functions, ".go": go_signals.go_functions}
TABLES = {".py": python_tables, ".go": go_signals.go_tables}
SYMBOLS = TABLES | {".json": json_shapes}
BRANCHES = {".go": go_signals.go_branches}
VALUES = {".go": go_signals.go_values}


def _with_extension(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1)).isin(list(extensions))).select("file", "text")


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of FUNCSIG, a bounded number at a time."""
    rows = iter(rows)
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array([zero if (v := r.get(k)) is None else v for r in some], schema.field(k).type) for k, zero in _ZERO.items()], schema=schema)


def extracted(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """FUNCSIG rows of files (file, text), by extension; each task reads its own files."""
    chosen = EXTRACTORS if extractors is None else extractors
    schema = to_arrow_schema(FUNCSIG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("file").to_pylist(), b.column("text").to_pylist())
            yield from _batches((r for file, text in pairs for r in chosen["." + file.rsplit(".", 1)[-1].lower()](file, text or "")), schema)

    return _with_extension(files, chosen).mapInArrow(run, FUNCSIG)


def shapes(files: DataFrame) -> DataFrame:
    """JSON shapes, of equal key sets the first by file: the first of each batch, then of all."""
    schema = to_arrow_schema(FUNCSIG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("file").to_pylist(), b.column("text").to_pylist())
            yield from _batches(first_shapes((file, text or "") for file, text in pairs), schema)

    found = _with_extension(files, [".json"]).mapInArrow(run, FUNCSIG)
    return found.groupBy(F.array_join("ret_keys", "\u0000").alias("__k")).agg(F.min_by(F.struct(*found.columns), F.struct("file", "qualname")).alias("r")).select("r.*")


def functions(files: DataFrame) -> DataFrame:
    return extracted(files)


def branches(files: DataFrame) -> DataFrame:
    """Arms of the outermost conditionals."""
    return extracted(files, BRANCHES)


def value_sites(files: DataFrame) -> DataFrame:
    """Literals where they are bound to a name."""
    return extracted(files, VALUES)


def symbols(files: DataFrame) -> DataFrame:
    """Module tables, JSON shapes (of equal key sets the first by file) and SQL schemas. A text reaches only the parsers of its own extension."""
    # texts without a schema never reach Python
    sql = extracted(files.where(F.upper("text").contains("CREATE TABLE")), {e: sql_tables for e in SQL_BEARING})
    return extracted(files, TABLES).unionByName(shapes(files)).unionByName(sql)
