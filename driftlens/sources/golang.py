"""A parser of Go source: tokens with their implied semicolons, then a tree by recursive descent.

Every node has a kind, its first and last line, and its children in the order in which they are looked at. A text that is not Go raises SyntaxError.
"""

from __future__ import annotations

import re
from collections.abc import Callable

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_TOKEN = re.compile(
    r"""[ \t\r]*(?:(?P<name>[^\W\d]\w*)|(?P<line>\n)|(?P<note>//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*")
    |(?P<num>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bBoO][\d_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?i?)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])
    |(?P<raw>`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\.)+')|(?P<rest>\Z))""",
    re.X | re.S,
)
LEVELS = {op: n for n, ops in enumerate(["||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^"], 1) for op in ops.split()}
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
DEEP = 400  # nested expressions, types or statements


class Token:
    __slots__ = ("kind", "text", "line", "last")

    def __init__(self, kind: str, text: str, line: int, last: int):
        self.kind, self.text, self.line, self.last = kind, text, line, last


class Node:
    """kind; line and last: its span; kids: nodes in order; and what else belongs to the kind."""

    def __init__(self, kind: str, line: int, kids: list[Node | None], **more):
        self.kind, self.line, self.last = kind, line, line
        self.kids = [k for k in kids if k is not None] if None in kids else kids
        if more:
            self.__dict__.update(more)

    def __getattr__(self, name: str):
        return None


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, open_end = 0, 1, False

    def close() -> None:
        nonlocal open_end
        if open_end:
            out.append(Token("auto", ";", line, line))
            open_end = False

    match, put = _TOKEN.match, out.append
    while True:
        m = match(text, at)
        if not m:
            raise SyntaxError(f"line {line}: {text[at]!r}")
        kind, at = m.lastgroup, m.end()
        piece = m[kind]
        if kind == "name":
            if piece in KEYWORDS:
                put(Token("key", piece, line, line))
                open_end = piece in _ENDS
            else:
                put(Token("name", piece, line, line))
                open_end = True
        elif kind == "op":
            put(Token("op", piece, line, line))
            open_end = piece in _ENDS
        elif kind == "line":
            close()
            line += 1
        elif kind == "note":
            if lines := piece.count("\n"):
                close()
                line += lines
        elif kind == "rest":
            break
        else:
            begin = line
            line += piece.count("\n")
            put(Token(kind, piece, begin, line))
            open_end = True
    close()
    out.append(Token("end", "", line, line))
    return out


def unquoted(token: str) -> str:
    """The text of a string literal."""
    if token[0] == "`":
        return token[1:-1].replace("\r", "")

    def one(m: re.Match) -> str:
        e = m[1]
        return chr(int(e[1:], 16)) if e[0] in "xuU" else chr(int(e, 8)) if e[0].isdigit() else _ESCAPES[e]

    return re.sub(r"\\(x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.)", one, token[1:-1])


class Parser:
    def __init__(self, text: str):
        self.all = tokens_of(text)
        self.marks = [t.text if t.kind in ("op", "key", "auto") else None for t in self.all]  # what can be seen, taken apart from names and literals
        self.lasts: list[int] = []  # of each token the last line of the last one so far that the text has
        for t in self.all:
            self.lasts.append(self.lasts[-1] if self.lasts and t.kind == "auto" else t.last)
        self.at, self.depth, self.clause = 0, 0, False  # clause: a brace begins a block, not a literal of a named type

    # --- tokens ---

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.all[self.at - 1]

    def sees(self, *texts: str) -> bool:
        return self.marks[self.at] in texts

    def skip(self, text: str) -> bool:
        if self.marks[self.at] == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.sees(text):
            raise SyntaxError(f"line {self.now.line}: {text!r} wanted, {self.now.text!r} found")
        return self.take()

    def name(self) -> Node:
        if self.now.kind != "name":
            raise SyntaxError(f"line {self.now.line}: a name wanted, {self.now.text!r} found")
        t = self.take()
        return Node("name", t.line, [], text=t.text)

    def end_of_statement(self) -> None:
        if not self.skip(";") and not self.sees(")", "}"):
            raise SyntaxError(f"line {self.now.line}: {self.now.text!r} after a statement")

    def done(self, node: Node) -> Node:
        """node with its last line."""
        last = self.lasts[self.at - 1]
        if last > node.last:
            node.last = last
        return node

    def nested(self, f: Callable, *args):
        self.depth += 1
        if self.depth > DEEP:
            raise SyntaxError("nested too deeply")
        try:
            return f(*args)
        finally:
            self.depth -= 1

    def outside_clause(self, f: Callable, *args):
        was, self.clause = self.clause, False
        try:
            return f(*args)
        finally:
            self.clause = was

    # --- files ---

    def file(self) -> Node:
        line = self.need("package").line
        self.name()
        self.end_of_statement()
        decls = []
        while self.now.kind != "end":
            if self.sees("func"):
                decls.append(self.function())
            elif self.sees("import", "const", "var", "type"):
                decls.append(self.declaration())
            else:
                raise SyntaxError(f"line {self.now.line}: {self.now.text!r} at the top")
            if self.now.kind != "end":
                self.need(";")
        return self.done(Node("file", line, decls))

    def function(self) -> Node:
        line = self.need("func").line
        receiver = self.parameters() if self.sees("(") else None
        name = self.name()
        kind = self.signature(line, generic=True)
        body = self.outside_clause(self.block) if self.sees("{") else None
        return self.done(Node("function", line, [receiver, name, kind, body], receiver=receiver, name=name.text, type=kind, body=body))

    def declaration(self) -> Node:
        word = self.take()
        specs, one = [], {"import": self.imported, "const": self.values, "var": self.values, "type": self.typed}[word.text]
        if self.skip("("):
            while not self.sees(")"):
                specs.append(one())
                self.end_of_statement()
            self.need(")")
        else:
            specs.append(one())
        return self.done(Node("declaration", word.line, specs, word=word.text))

    def imported(self) -> Node:
        line = self.now.line
        alias = self.take().text if self.now.kind == "name" or self.sees(".") else None
        path = self.take()
        if path.kind not in ("str", "raw"):
            raise SyntaxError(f"line {path.line}: an import without a path")
        return Node("import", line, [Node("literal", path.line, [])], alias=alias, path=unquoted(path.text))

    def values(self) -> Node:
        line = self.now.line
        names = [self.name()]
        while self.skip(","):
            names.append(self.name())
        kind = None if self.sees("=", ";", ")") else self.type()
        values = self.expressions() if self.skip("=") else []
        return self.done(Node("values", line, [*names, kind, *values], names=names, values=values))

    def typed(self) -> Node:
        name = self.name()
        parameters = None
        if self.sees("["):  # type parameters or an array type
            back = self.at
            try:
                self.take()
                parameters = self.type_parameters()
            except SyntaxError:
                self.at, parameters = back, None
        self.skip("=")
        kind = self.type()
        return self.done(Node("typed", name.line, [name, parameters, kind]))

    def type_parameters(self) -> Node:
        """After the opening bracket: names, then their constraint."""
        fields, line = [], self.now.line
        while not self.sees("]"):
            names = [self.name()]
            while self.skip(","):
                names.append(self.name())
            fields.append(Node("field", names[0].line, [*names, self.constraint()], names=names))
            if not self.skip(","):
                break
        self.need("]")
        if not fields:
            raise SyntaxError("no type parameters")
        return Node("fields", line, fields)

    def constraint(self) -> Node:
        def one() -> Node:
            if self.sees("~"):
                line = self.take().line
                return Node("unary", line, [self.type()], op="~")
            return self.type()

        out = one()
        while self.skip("|"):
            out = Node("binary", out.line, [out, one()], op="|")
        return out

    # --- types ---

    def type(self) -> Node:
        return self.nested(self._type)

    def _type(self) -> Node:
        t = self.now
        if t.kind == "name":
            x = self.name()
            if self.skip("."):
                x = self.selector(x)
            if self.sees("[") and not (self.all[self.at + 1].text == "]"):
                self.take()
                arguments = [self.type()]
                while self.skip(",") and not self.sees("]"):
                    arguments.append(self.type())
                self.need("]")
                x = self.done(Node("index", t.line, [x, *arguments], x=x))
            return x
        if self.skip("("):
            x = self.type()
            self.need(")")
            return self.done(Node("paren", t.line, [x], x=x))
        if self.skip("*"):
            x = self.type()
            return self.done(Node("star", t.line, [x], x=x))
        if self.skip("["):
            length = None
            if self.sees("..."):
                length = Node("ellipsis", self.take().line, [])
            elif not self.sees("]"):
                length = self.outside_clause(self.expression)
            self.need("]")
            element = self.type()
            return self.done(Node("array", t.line, [length, element]))
        if self.skip("map"):
            self.need("[")
            key = self.type()
            self.need("]")
            return self.done(Node("map", t.line, [key, self.type()]))
        if self.sees("chan", "<-"):
            self.skip("<-")
            self.need("chan")
            self.skip("<-")
            return self.done(Node("chan", t.line, [self.type()]))
        if self.skip("func"):
            return self.signature(t.line)
        if self.skip("struct"):
            return self.members("struct", t.line)
        if self.skip("interface"):
            return self.members("interface", t.line)
        raise SyntaxError(f"line {t.line}: a type wanted, {t.text!r} found")

    def members(self, kind: str, line: int) -> Node:
        self.need("{")
        fields = []
        while not self.sees("}"):
            begin = self.now.line
            if kind == "interface":
                if self.now.kind == "name" and self.all[self.at + 1].text == "(":
                    name = self.name()
                    fields.append(Node("field", begin, [name, self.signature(begin)], names=[name]))
                else:
                    fields.append(Node("field", begin, [self.constraint()], names=[]))
            else:
                names = []
                after = self.all[self.at + 1]
                if self.now.kind == "name" and after.text not in (".", ";", "}") and after.kind not in ("str", "raw"):
                    names.append(self.name())
                    while self.skip(","):
                        names.append(self.name())
                of = self.type()
                tag = Node("literal", self.now.line, [], token=self.take()) if self.now.kind in ("str", "raw") else None
                fields.append(Node("field", begin, [*names, of, tag], names=names))
            self.end_of_statement()
        self.need("}")
        return self.done(Node(kind, line, [Node("fields", line, fields)]))

    def signature(self, line: int, generic: bool = False) -> Node:
        """Parameters and results, after func and the name."""
        kinds = None
        if generic and self.skip("["):
            kinds = self.type_parameters()
        parameters = self.parameters()
        results = None
        if self.sees("("):
            results = self.parameters()
        elif self.now.kind == "name" or self.sees("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            begin = self.at
            of = self.type()
            results = Node("fields", of.line, [Node("field", of.line, [of], names=[], type=of, text=self.text_of(begin, self.at))])
        return self.done(Node("signature", line, [kinds, parameters, results], parameters=parameters, results=results))

    def text_of(self, begin: int, end: int) -> str:
        return "".join(t.text for t in self.all[begin:end] if t.kind != "auto")

    def parameters(self) -> Node:
        """Each entry is a type or a name with one; if any has both, all single ones are names of the type that follows."""
        line = self.need("(").line
        entries: list[tuple[Node | None, Node | None, str]] = []
        while not self.sees(")"):
            entries.append(self.outside_clause(self.parameter))
            if not self.skip(","):
                break
        self.need(")")
        fields: list[Node] = []
        if any(name and of for name, of, _ in entries):
            held: list[Node] = []
            for name, of, text in entries:
                if not name:
                    raise SyntaxError(f"line {line}: parameters with and without names")
                held.append(name)
                if of:
                    fields.append(Node("field", held[0].line, [*held, of], names=held, type=of, text=text))
                    held = []
            if held:
                raise SyntaxError(f"line {line}: a parameter without a type")
        else:
            fields = [Node("field", (of or name).line, [of or name], names=[], type=of or name, text=text) for name, of, text in entries]
        return self.done(Node("fields", line, fields))

    def parameter(self) -> tuple[Node | None, Node | None, str]:
        def of() -> Node:
            if self.sees("..."):
                line = self.take().line
                return Node("ellipsis", line, [self.type()])
            return self.type()

        begin = self.at
        if self.now.kind == "name" and self.all[self.at + 1].text in (",", ")"):
            return self.name(), None, self.all[begin].text
        if self.now.kind == "name" and self.all[self.at + 1].text != ".":
            # a name before its type, or a generic type alone
            try:
                name = self.name()
                start = self.at
                kind = of()
                if self.sees(",", ")"):
                    return name, kind, self.text_of(start, self.at)
            except SyntaxError:
                pass
            self.at = begin
        kind = of()
        return None, kind, self.text_of(begin, self.at)

    # --- expressions ---

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.skip(","):
            out.append(self.expression())
        return out

    def expression(self, level: int = 1) -> Node:
        self.depth += 1
        if self.depth > DEEP:
            raise SyntaxError("nested too deeply")
        try:
            x = self.unary()
            while LEVELS.get(self.marks[self.at], 0) >= level:
                op = self.take().text
                y = self.expression(LEVELS[op] + 1)
                x = self.done(Node("binary", x.line, [x, y], op=op, x=x, y=y))
            return x
        finally:
            self.depth -= 1

    def unary(self) -> Node:
        t = self.all[self.at]
        if self.marks[self.at] is None:
            return self.suffixes(self.operand())
        if self.sees("<-") and self.all[self.at + 1].text == "chan":
            return self.suffixes(self.type())
        if self.sees("*"):
            self.take()
            x = self.nested(self.unary)
            return self.done(Node("star", t.line, [x], x=x))
        if self.sees("+", "-", "!", "^", "&", "<-", "~"):
            self.take()
            x = self.nested(self.unary)
            return self.done(Node("unary", t.line, [x], op=t.text, x=x))
        return self.suffixes(self.operand())

    def operand(self) -> Node:
        t = self.now
        if t.kind == "name":
            return self.name()
        if t.kind in ("num", "char", "str", "raw"):
            return Node("literal", t.line, [], token=self.take())
        if self.skip("("):
            x = self.outside_clause(self.either)
            self.need(")")
            return self.done(Node("paren", t.line, [x], x=x))
        if self.sees("func"):
            self.take()
            kind = self.signature(t.line)
            if self.sees("{"):
                body = self.outside_clause(self.block)
                return self.done(Node("closure", t.line, [kind, body], body=body))
            return kind
        if self.sees("[", "map", "chan", "struct", "interface"):
            return self.type()
        raise SyntaxError(f"line {t.line}: an expression wanted, {t.text!r} found")

    def either(self) -> Node:
        """An expression or a type; types that begin like no expression are told by their first token."""
        return self.type() if self.sees("[", "map", "chan", "struct", "interface") and not self._literal_ahead() else self.expression()

    def _literal_ahead(self) -> bool:
        back = self.at
        try:
            self.type()
            return self.sees("{", "(")
        except SyntaxError:
            return True
        finally:
            self.at = back

    def selector(self, x: Node) -> Node:
        leaf = self.name()
        return self.done(Node("selector", x.line, [x, leaf], x=x, leaf=leaf.text))

    def suffixes(self, x: Node) -> Node:
        while True:
            mark = self.marks[self.at]
            if mark not in (".", "[", "(", "{"):
                return x
            if mark == ".":
                self.at += 1
                if self.skip("("):
                    of = None if self.skip("type") else self.type()
                    self.need(")")
                    x = self.done(Node("assertion", x.line, [x, of], x=x, type=of))
                else:
                    x = self.selector(x)
            elif mark == "[":
                x = self.outside_clause(self.index, x)
            elif mark == "(":
                x = self.outside_clause(self.call, x)
            elif self._may_be_literal(x):
                x = self.outside_clause(self.composite, x)
            else:
                return x

    def _may_be_literal(self, x: Node) -> bool:
        if x.kind in ("array", "map", "struct"):
            return True
        named = x.kind == "name" or x.kind == "selector" and x.x.kind == "name" or x.kind == "index" and x.x.kind in ("name", "selector")
        return named and not self.clause

    def index(self, x: Node) -> Node:
        self.need("[")
        parts: list[Node | None] = [None]
        colons = 0
        many: list[Node] = []
        while not self.sees("]"):
            if self.skip(":"):
                colons += 1
                parts.append(None)
            elif self.skip(","):
                many.append(parts[-1])
                parts[-1] = None
            else:
                parts[-1] = self.either()
        self.need("]")
        if colons:
            return self.done(Node("slice", x.line, [x, *parts], x=x))
        return self.done(Node("index", x.line, [x, *many, parts[-1]], x=x))

    def call(self, fun: Node) -> Node:
        self.need("(")
        arguments = []
        while not self.sees(")"):
            arguments.append(self.either())
            self.skip("...")
            if not self.skip(","):
                break
        self.need(")")
        return self.done(Node("call", fun.line, [fun, *arguments], fun=fun, args=arguments))

    def composite(self, of: Node | None) -> Node:
        line = self.need("{").line
        elements = []

        def element() -> Node:
            return self.nested(self.composite, None) if self.sees("{") else self.expression()

        while not self.sees("}"):
            e = element()
            if self.skip(":"):
                value = element()
                e = self.done(Node("pair", e.line, [e, value], key=e, value=value))
            elements.append(e)
            if not self.skip(","):
                break
        self.need("}")
        return self.done(Node("composite", of.line if of else line, [of, *elements], type=of, elements=elements))

    # --- statements ---

    def block(self) -> Node:
        line = self.need("{").line
        body = self.statements()
        self.need("}")
        return self.done(Node("block", line, body, body=body))

    def statements(self) -> list[Node]:
        out = []
        while not self.sees("}", "case", "default") and self.now.kind != "end":
            s = self.nested(self.statement)
            if s:
                out.append(s)
            if self.sees("}", "case", "default"):
                break
            self.end_of_statement()
        return out

    def statement(self) -> Node | None:
        t = self.now
        if self.sees(";"):
            return None
        if self.sees("{"):
            return self.block()
        if t.kind == "key":
            if t.text in ("var", "const", "type"):
                d = self.declaration()
                return self.done(Node("declared", t.line, [d]))
            if t.text in ("go", "defer"):
                self.take()
                return self.done(Node(t.text, t.line, [self.expression()]))
            if t.text == "return":
                self.take()
                results = [] if self.sees(";", "}") else self.expressions()
                return self.done(Node("return", t.line, results, results=results))
            if t.text in ("break", "continue", "goto", "fallthrough"):
                self.take()
                return self.done(Node("jump", t.line, [self.name() if self.now.kind == "name" else None]))
            if t.text == "if":
                return self.condition()
            if t.text == "switch":
                return self.switch()
            if t.text == "select":
                self.take()
                return self.done(Node("select", t.line, [self.clauses("comm")]))
            if t.text == "for":
                return self.loop()
        s = self.simple()
        if s.kind == "plain" and s.kids[0].kind == "name" and self.skip(":"):
            inner = None if self.sees("}") else self.nested(self.statement)
            return self.done(Node("labeled", t.line, [s.kids[0], inner]))
        return s

    def simple(self, ranged: bool = False) -> Node:
        """An assignment, a step, a send or an expression; in a for clause also a range."""
        t = self.now
        if ranged and self.skip("range"):
            x = self.expression()
            return self.done(Node("range", t.line, [x], parts=[x]))
        left = self.expressions()
        if self.now.kind == "op":
            op = self.now.text
            if op in ("++", "--"):
                self.take()
                return self.done(Node("step", t.line, left, x=left[0]))
            if op == "<-":
                self.take()
                return self.done(Node("send", t.line, [left[0], self.expression()]))
            if op == ":=" or op.endswith("=") and op not in ("==", "!=", "<=", ">="):
                self.take()
                if ranged and self.skip("range"):
                    x = self.expression()
                    return self.done(Node("range", t.line, [*left, x], parts=[*left, x]))
                right = self.expressions()
                return self.done(Node("assign", t.line, [*left, *right], left=left, right=right, op=op))
        return self.done(Node("plain", t.line, [left[0]]))

    def header(self) -> tuple[Node | None, Node | None]:
        """(init, condition or tag) before a block."""
        was, self.clause = self.clause, True
        try:
            first = None if self.sees("{", ";") else self.simple()
            if self.skip(";"):
                return first, None if self.sees("{") else self.simple()
            return None, first
        finally:
            self.clause = was

    def condition(self) -> Node:
        line = self.need("if").line
        init, cond = self.header()
        if cond is None or cond.kind != "plain":
            raise SyntaxError(f"line {line}: no condition")
        cond = cond.kids[0]
        body = self.outside_clause(self.block)
        other = None
        if self.skip("else"):
            other = self.nested(self.condition) if self.sees("if") else self.outside_clause(self.block)
        return self.done(Node("if", line, [init, cond, body, other], init=init, cond=cond, body=body, other=other))

    def switch(self) -> Node:
        line = self.need("switch").line
        init, tag = self.header()
        typed = False
        if tag is not None:
            x = tag.kids[0] if tag.kind == "plain" else tag.right[0] if tag.kind == "assign" and len(tag.right) == 1 else None
            typed = x is not None and x.kind == "assertion" and x.type is None
            if tag.kind == "plain" and not typed:
                tag = tag.kids[0]
        return self.done(Node("switch", line, [init, tag, self.clauses("case")]))

    def clauses(self, kind: str) -> Node:
        line = self.need("{").line
        out = []
        while not self.sees("}"):
            begin = self.now.line
            heads: list[Node | None] = []
            if self.skip("default"):
                pass
            else:
                self.need("case")
                if kind == "comm":
                    heads = [self.outside_clause(self.simple)]
                else:
                    heads = [self.outside_clause(self.either)]
                    while self.skip(","):
                        heads.append(self.outside_clause(self.either))
            self.need(":")
            body = self.outside_clause(self.statements)
            out.append(self.done(Node("clause", begin, [*heads, *body], body=body)))
        self.need("}")
        return self.done(Node("block", line, out, body=out))

    def loop(self) -> Node:
        line = self.need("for").line
        was, self.clause = self.clause, True
        try:
            first = None if self.sees("{", ";") else self.simple(ranged=True)
            if first is not None and first.kind == "range":
                parts = first.parts
            elif self.skip(";"):
                cond = None if self.sees(";") else self.simple()
                self.need(";")
                post = None if self.sees("{") else self.simple()
                parts = [first, cond.kids[0] if cond else None, post]
            else:
                parts = [first.kids[0]] if first else []
        finally:
            self.clause = was
        body = self.outside_clause(self.block)
        return self.done(Node("for", line, [*parts, body], body=body))


def parse(text: str) -> Node:
    return Parser(text).file()
