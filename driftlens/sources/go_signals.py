"""Go source to FUNCSIG rows: functions, tables, branch arms and value sites, from the tree of driftlens.sources.golang."""

from __future__ import annotations

import re
from collections.abc import Iterator

from driftlens.sources import golang
from driftlens.sources.golang import Node

_CONST = re.compile(r"[A-Z][A-Z0-9_]{2,}\Z")
_COMPARISONS = frozenset("== != < <= > >=".split())
ROOTS = frozenset("_engine _impl _inner _delegate _wrapped _backend _real _target".split())


def _tree(text: str) -> Node | None:
    try:
        return golang.parse(text)
    except (SyntaxError, RecursionError, ValueError):
        return None


def _path(node: Node) -> str:
    """Dotted selectors without the name they hang on; '' if they hang on something else."""
    parts = []
    while node.kind == "selector":
        parts.append(node.leaf)
        node = node.x
    return ".".join(reversed(parts)) if node.kind == "name" else ""


def _string(node: Node) -> str | None:
    return golang.unquoted(node.token.text) if node.kind == "literal" and node.token.kind in ("str", "raw") else None


def _key(node: Node) -> str:
    return node.text if node.kind == "name" else _string(node) or ""


def _is_nil(node: Node) -> bool:
    return node.kind == "name" and node.text == "nil"


class _Signals:
    """What a stretch of code touches."""

    def __init__(self, roots: list[Node]):
        self.strings, self.writes, self.raw_reads, self.assigned, self.keys, self.calls, self.consts = (set() for _ in range(7))
        self.shapes: dict[str, set[str]] = {}
        self.delegates, self.nodes = False, 0
        callees: set[int] = set()
        todo: list[tuple[Node, tuple[Node, ...]]] = [(r, ()) for r in reversed(roots)]
        while todo:
            node, above = todo.pop()
            self.nodes += 1
            look = _LOOKS.get(node.kind)
            if look:
                look(self, node, above, callees)
            if node.kids:
                near = (node, *above[:2])
                todo += [(k, near) for k in reversed(node.kids)]

    @property
    def reads(self) -> set[str]:
        return self.raw_reads - self.assigned

    def _on_literal(self, node, above, callees):
        s = _string(node)
        if s is not None and len((s := s.strip()).encode("utf-8", "surrogatepass")) >= 4:
            self.strings.add(s)

    def _on_name(self, node, above, callees):
        if _CONST.match(node.text):
            self.consts.add(node.text)

    def _on_selector(self, node, above, callees):
        if id(node) not in callees and (p := _path(node)):
            self.raw_reads.add(p)
        if _CONST.match(node.leaf):
            self.consts.add(node.leaf)

    def _on_call(self, node, above, callees):
        leaf = node.fun.text if node.fun.kind == "name" else node.fun.leaf if node.fun.kind == "selector" else None
        if leaf is None:
            return
        self.calls.add(leaf)
        if node.fun.kind == "selector":
            callees.add(id(node.fun))
            root, dot, _ = _path(node.fun).partition(".")
            self.delegates |= bool(dot) and root in ROOTS
        self.shapes.setdefault(leaf, set()).update(self._shapes_of(node, above))

    def _shapes_of(self, call: Node, above: tuple[Node, ...]) -> Iterator[str]:
        yield f"arg-count:{len(call.args)}"
        parent = above[0] if above else None
        if parent is None:
            return
        if parent.kind == "binary" and parent.op in _COMPARISONS:
            yield "ret-nil-checked" if parent.op in ("==", "!=") and (_is_nil(parent.x) or _is_nil(parent.y)) else "ret-compared"
        elif parent.kind == "call" and any(a is call for a in parent.args):
            yield "ret-passed-to-call"
        elif parent.kind == "return":
            yield "ret-returned"
        elif parent.kind == "assign":
            place = next((i for i, r in enumerate(parent.right) if r is call), None)
            if place is not None and len(parent.left) == len(parent.right) and parent.left[place].kind in ("selector", "index"):
                yield "ret-assigned-field"
            check = self._check_of(parent, above[1] if len(above) > 1 else None)
            if check:
                yield check

    @staticmethod
    def _check_of(assign: Node, around: Node | None) -> str | None:
        """How the if that belongs to an assignment, or follows it at once, tests one of its names against nil."""
        cond = None
        if around is not None and around.kind == "if" and around.init is assign:
            cond = around.cond
        elif around is not None and around.kind == "block":
            after = next((around.body[i + 1] for i, s in enumerate(around.body[:-1]) if s is assign), None)
            cond = after.cond if after is not None and after.kind == "if" and after.init is None else None
        if cond is None or cond.kind != "binary" or cond.op not in ("==", "!="):
            return None
        name = cond.x.text if cond.x.kind == "name" and _is_nil(cond.y) else cond.y.text if cond.y.kind == "name" and _is_nil(cond.x) else None
        if name is None or not any(x.kind == "name" and x.text == name for x in assign.left):
            return None
        return "ret-err-checked" if name == "err" else "ret-nil-checked"

    def _written(self, target: Node) -> None:
        if target.kind == "selector" and (p := _path(target)):
            self.writes.add(p)
        elif target.kind == "index" and (p := _path(target.x)):
            self.writes.add(p + "[]")

    def _on_assign(self, node, above, callees):
        for x in node.left:
            self._written(x)
            if node.op == "=" and (p := _path(x)):
                self.assigned.add(p)

    def _on_step(self, node, above, callees):
        self._written(node.x)

    def _on_return(self, node, above, callees):
        for r in node.results:
            if r.kind == "composite":
                self.keys |= {k for e in r.elements if e.kind == "pair" and (k := _key(e.key))}

    def fields(self) -> dict:
        return {
            "node_count": self.nodes, "strings": sorted(self.strings), "writes": sorted(self.writes), "reads": sorted(self.reads), "ret_keys": sorted(self.keys), "calls": sorted(self.calls), "consts": sorted(self.consts),
            "delegates": self.delegates, "call_result_shapes": {k: sorted(v) for k, v in self.shapes.items()},
        }


_LOOKS = {name.removeprefix("_on_"): f for name, f in vars(_Signals).items() if name.startswith("_on_")}


def _receiver(function: Node) -> str:
    """Name of a method's type."""
    if function.receiver is None or not function.receiver.kids:
        return ""
    node = function.receiver.kids[0].type
    while node.kind in ("star", "paren", "index"):
        node = node.x
    return node.text if node.kind == "name" else ""


def _qualified(function: Node) -> str:
    receiver = _receiver(function)
    return f"{receiver}.{function.name}" if receiver else function.name


def _imports(tree: Node) -> dict[str, str]:
    specs = [s for d in tree.kids if d.kind == "declaration" and d.word == "import" for s in d.kids]
    return {s.alias or s.path.rsplit("/", 1)[-1]: s.path for s in specs}


def _type_text(field: Node, imports: dict[str, str]) -> str:
    """A type without white space; one of the standard library, whose paths have no dot before the first slash, is its package alone."""
    of = field.type.x if field.type.kind == "star" else field.type
    if of.kind == "selector" and of.x.kind == "name" and of.x.text in imports and "." not in imports[of.x.text].split("/", 1)[0]:
        return of.x.text
    return re.sub(r"\s", "", field.text)


def _signature(function: Node, imports: dict[str, str]) -> str:
    flat = lambda fields: [t for f in (fields.kids if fields else ()) for t in [_type_text(f, imports)] * max(1, len(f.names))]
    results = flat(function.type.results)
    out = results[0] if len(results) == 1 else f"({','.join(results)})"
    return f"({','.join(flat(function.type.parameters))})=>{out}"


def _functions(tree: Node) -> Iterator[Node]:
    return (d for d in tree.kids if d.kind == "function" and d.body is not None)


def go_functions(file: str, text: str) -> list[dict]:
    tree = _tree(text)
    if tree is None:
        return []
    declared = sorted({n.text for d in tree.kids if d.kind == "declaration" and d.word in ("const", "var") for s in d.kids for n in s.names if _CONST.match(n.text)})
    imports = _imports(tree)
    return [
        {"file": file, "qualname": _qualified(f), "name": f.name, "line": f.body.line, "n_lines": f.body.last - f.body.line + 1, "decl_consts": declared, "sig": _signature(f, imports)} | _Signals([f.body]).fields()
        for f in _functions(tree)
    ]


def go_tables(file: str, text: str, least: int = 3) -> list[dict]:
    """Map literals by their keys, lists of strings by their elements; exported ones, or those with enough keys."""
    tree, out = _tree(text), []
    for d in tree.kids if tree else ():
        for spec in d.kids if d.kind == "declaration" and d.word in ("const", "var") else ():
            for name, value in zip(spec.names, spec.values):
                if value.kind != "composite" or value.type is None:
                    continue
                keys, values = set(), set()
                for e in value.elements:
                    if value.type.kind == "map" and e.kind == "pair" and (k := _key(e.key)):
                        keys.add(k)
                        values.add(_string(e.value) or "")
                    elif value.type.kind == "array":
                        keys.add(_string(e) or "")
                keys.discard("")
                values.discard("")
                if keys and (name.text[0].isupper() or len(keys) >= least):
                    out.append({"file": file, "qualname": name.text, "name": name.text, "kind": "table", "line": spec.line, "n_lines": spec.last - spec.line + 1, "strings": sorted(values), "ret_keys": sorted(keys)})
    return out


def go_branches(file: str, text: str) -> list[dict]:
    """The arms of the outermost conditionals of each function; empty ones are none."""
    tree, out = _tree(text), []
    for f in _functions(tree) if tree else ():
        qualname, n = _qualified(f), 0

        def arm(roots: list[Node], line: int, last: int) -> None:
            nonlocal n
            if roots:
                n += 1
                out.append({"file": file, "qualname": f"{qualname}#branch@{line}.{n}", "name": f.name, "kind": "branch", "line": line, "n_lines": last - line + 1} | _Signals(roots).fields())

        todo = [f.body]
        while todo:
            node = todo.pop()
            if node.kind in ("switch", "select"):
                for clause in node.kids[-1].body:
                    arm(clause.body, clause.line, clause.last)
            elif node.kind == "if":
                while node is not None:
                    block, node = (node.body, node.other) if node.kind == "if" else (node, None)
                    if block.body:
                        arm([block], block.line, block.last)
            else:
                todo += reversed(node.kids)
    return out


def _value(node: Node) -> str | None:
    """A literal worth following: no 0, 1 or empty text, also not behind a sign."""
    if node.kind == "unary" and node.op == "-":
        inner = _value(node.x)
        return None if inner is None else "-" + inner
    if node.kind != "literal":
        return None
    if node.token.kind == "num" and node.token.text[-1] != "i":
        return None if node.token.text in ("0", "1") else node.token.text
    return _string(node) or None


def go_values(file: str, text: str) -> list[dict]:
    """Literals bound to a name by assignment, declaration or as a field or key of a literal."""
    tree, out = _tree(text), []

    def bound(node: Node) -> Iterator[tuple[str, Node]]:
        if node.kind == "assign" and len(node.left) == len(node.right):
            yield from ((x.text, v) for x, v in zip(node.left, node.right) if x.kind == "name" and x.text != "_")
        elif node.kind == "values" and len(node.names) == len(node.values):
            yield from ((x.text, v) for x, v in zip(node.names, node.values) if x.text != "_")
        elif node.kind == "pair" and (k := _key(node.key)):
            yield k, node.value

    for d in tree.kids if tree else ():
        if d.kind == "function" and d.body is None:
            continue
        inside = f"{_qualified(d)}." if d.kind == "function" else ""
        todo = [d.body if d.kind == "function" else d]
        while todo:
            node = todo.pop()
            for name, v in bound(node):
                if (value := _value(v)) is not None:
                    out.append({"file": file, "qualname": f"{inside}{name}#value@{v.line}.{len(out) + 1}", "name": name, "kind": "value-site", "value": value, "line": v.line, "n_lines": 1})
            todo += reversed(node.kids)
    return out
