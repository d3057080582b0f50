"""The query language's grammar: text -> tokens -> a tree of clauses, patterns and expressions. Nothing here knows of tables.

Expressions are tuples whose first part names their kind; clauses and patterns are the data classes below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/|(?P<num>0[xX][0-9A-Fa-f]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+|\.\d+(?:[eE][+-]?\d+)?)"""
    r"""|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*|`[^`]+`)|(?P<param>\$\w+)"""
    r"""|(?P<op><>|!=|<=|>=|=~|\+=|\.\.|[-+*/%^=<>()\[\]{},.:;|])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int = 0
    end: int = 0

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" and self.text[0] != "`" else ""


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"cannot read the query at {text[at:at + 20]!r}")
        # "1..2" is a range, not the number 1. and .2
        if m.lastgroup == "num" and m[0][0] == "." and out and out[-1].end == at and out[-1].text == ".":
            raise SyntaxError(f"cannot read the query at {text[at:at + 20]!r}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


# labels: all of the alternatives' lists hold one label each for `A:B` (and), or one list with several for `A|B` (or)
Label = str | tuple


@dataclass
class NodePattern:
    var: str | None
    labels: list[list[Label]]
    props: list[tuple[str, tuple]]
    whole: tuple | None = None  # a parameter in place of the properties


@dataclass
class Lambda:
    edge: str
    node: str
    path: str | None
    weight: str | None
    body: tuple


@dataclass
class RelPattern:
    var: str | None
    types: list[Label]
    props: list[tuple[str, tuple]]
    direction: str  # out, in, both
    kind: str = "one"  # one, walk, bfs, wshortest, allshortest, kshortest
    low: tuple | None = None
    high: tuple | None = None
    k: tuple | None = None
    weigh: Lambda | None = None
    total: str | None = None
    keep: Lambda | None = None
    whole: tuple | None = None


@dataclass
class Path:
    var: str | None
    parts: list  # NodePattern, RelPattern, NodePattern ...


@dataclass
class Match:
    paths: list[Path]
    where: tuple | None
    optional: bool


@dataclass
class Unwind:
    items: tuple
    var: str


@dataclass
class Item:
    name: str
    value: tuple
    spelled: str


@dataclass
class Project:
    """WITH or RETURN."""

    final: bool
    distinct: bool
    everything: bool
    items: list[Item]
    order: list[tuple[Item, bool]]
    skip: tuple | None
    limit: tuple | None
    where: tuple | None = None


@dataclass
class Call:
    name: str
    args: list[tuple]
    fields: list[tuple[str, str]] | None  # None: nothing is yielded by name; ("*", "*"): every column
    where: tuple | None = None


@dataclass
class Subquery:
    query: Query
    imports: list[str] | None  # None: WITH inside names them


@dataclass
class Load:
    kind: str
    source: tuple
    options: dict[str, tuple | bool]
    var: str


@dataclass
class Create:
    paths: list[Path]


@dataclass
class Merge:
    path: Path
    on_create: list
    on_match: list


@dataclass
class Change:
    """One SET or REMOVE item: kind is property, replace, add, labels, drop_property or drop_labels."""

    kind: str
    var: str
    keys: list[str] = field(default_factory=list)
    value: tuple | None = None
    labels: list[Label] = field(default_factory=list)


@dataclass
class Changes:
    items: list[Change]


@dataclass
class Delete:
    values: list[tuple]
    detach: bool


@dataclass
class Foreach:
    var: str
    items: tuple
    body: list


@dataclass
class Single:
    clauses: list


@dataclass
class Query:
    parts: list[Single]
    every: list[bool]  # UNION ALL between part i and i + 1
    hops: tuple | None = None
    explain: bool = False


_COMPARE = ("=", "<>", "!=", "<", "<=", ">", ">=")
_QUANTIFIERS = ("all", "any", "none", "single", "filter", "extract")


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens_of(text), 0

    # a cursor over tokens

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else Token("end", "", len(self.text), len(self.text))

    def sees(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind not in ("str", "num") and (t.kind == "op" and t.text in texts or bool(t.word) and t.word in texts)

    def take(self, *texts: str) -> bool:
        found = self.sees(*texts)
        self.at += found
        return found

    def need(self, *texts: str) -> None:
        for text in texts:
            if not self.take(text):
                raise SyntaxError(f"{text!r} is expected before {self.peek().text!r}")

    def name(self) -> str:
        t = self.peek()
        if t.kind != "name":
            raise SyntaxError(f"a name is expected before {t.text!r}")
        self.at += 1
        return t.text.strip("`")

    def spelled(self, begin: int) -> str:
        """The query's own text of the tokens from begin."""
        return self.text[self.tokens[begin].at : self.tokens[self.at - 1].end] if self.at > begin else ""

    def attempt(self, read):
        """What read() gives, or None with the cursor where it was."""
        begin = self.at
        try:
            return read()
        except SyntaxError:
            self.at = begin
            return None

    # queries and clauses

    def whole(self) -> Query:
        explain = self.take("EXPLAIN", "PROFILE")
        query = self.query()
        query.explain = explain
        self.take(";")
        if self.peek().kind != "end":
            raise SyntaxError(f"cannot read {self.peek().text!r}")
        return query

    def query(self) -> Query:
        hops = self.directives()
        out = Query([self.single()], [], hops)
        while self.take("UNION"):
            out.every.append(self.take("ALL"))
            out.parts.append(self.single())
        if self.sees("QUERY"):
            self.memory_limit()
        return out

    def memory_limit(self) -> None:
        self.at += 1
        self.need("MEMORY")
        if not self.take("UNLIMITED"):
            self.need("LIMIT")
            self.expression()
            if not self.take("MB", "KB"):
                raise SyntaxError("MB or KB is expected")

    def directives(self) -> tuple | None:
        """USING hints; only HOPS LIMIT changes rows."""
        hops = None
        if self.take("USING"):
            while True:
                if self.take("HOPS"):
                    self.need("LIMIT")
                    hops = self.expression()
                elif self.take("PERIODIC"):
                    self.need("COMMIT")
                    self.expression()
                elif self.take("PARALLEL"):
                    self.need("EXECUTION")
                    if self.peek().kind == "num":
                        self.at += 1
                else:
                    self.need("INDEX")
                    while self.take(":"):
                        if not self.take("("):
                            self.name()
                        else:
                            self.at -= 1
                        if self.take("("):
                            while not self.take(")"):
                                self.at += 1
                        if self.sees(",") and self.sees(":", ahead=1):
                            self.at += 1
                if not self.take(","):
                    return hops
        return hops

    def single(self) -> Single:
        clauses = []
        while True:
            t = self.peek()
            if t.kind == "end" or self.sees(";", "}", ")", "UNION", "QUERY"):
                break
            clauses.append(self.clause())
            if isinstance(clauses[-1], Project) and clauses[-1].final:
                break
        if not clauses:
            raise SyntaxError(f"a clause is expected before {self.peek().text!r}")
        return Single(clauses)

    def clause(self):
        if self.take("OPTIONAL"):
            self.need("MATCH")
            return self.match(True)
        if self.take("MATCH"):
            return self.match(False)
        if self.take("UNWIND"):
            items = self.expression()
            self.need("AS")
            return Unwind(items, self.name())
        if self.take("WITH"):
            out = self.project(False)
            out.where = self.where()
            return out
        if self.take("RETURN"):
            return self.project(True)
        if self.take("CALL"):
            return self.call()
        if self.take("LOAD"):
            return self.load()
        found = self.write()
        if found is None:
            raise SyntaxError(f"a clause is expected before {self.peek().text!r}")
        return found

    def write(self):
        if self.take("CREATE"):
            return Create(self.paths())
        if self.take("MERGE"):
            out = Merge(self.path(), [], [])
            while self.take("ON"):
                side = out.on_create if self.sees("CREATE") else out.on_match
                if not self.take("CREATE", "MATCH"):
                    raise SyntaxError("ON CREATE or ON MATCH is expected")
                self.need("SET")
                side += self.changes()
            return out
        if self.take("SET"):
            return Changes(self.changes())
        if self.take("REMOVE"):
            items = []
            while not items or self.take(","):
                var = self.name()
                if self.sees(":"):
                    items.append(Change("drop_labels", var, labels=self.labels_all()))
                else:
                    items.append(Change("drop_property", var, self.dotted()))
            return Changes(items)
        if self.sees("DETACH", "DELETE"):
            detach = self.take("DETACH")
            self.need("DELETE")
            values = [self.expression()]
            while self.take(","):
                values.append(self.expression())
            return Delete(values, detach)
        if self.take("FOREACH"):
            self.need("(")
            var = self.name()
            self.need("IN")
            items = self.expression()
            self.need("|")
            body = []
            while not self.take(")"):
                one = self.write()
                if one is None:
                    raise SyntaxError(f"an update is expected before {self.peek().text!r}")
                body.append(one)
            return Foreach(var, items, body)
        return None

    def dotted(self) -> list[str]:
        keys = []
        while self.take("."):
            keys.append(self.name())
        if not keys:
            raise SyntaxError(f"a property is expected before {self.peek().text!r}")
        return keys

    def changes(self) -> list[Change]:
        out = []
        while not out or self.take(","):
            bracketed = self.take("(")
            var = self.name()
            if bracketed:
                self.need(")")
            if self.sees(":"):
                out.append(Change("labels", var, labels=self.labels_all()))
            elif self.take("+="):
                out.append(Change("add", var, value=self.expression()))
            elif self.take("="):
                out.append(Change("replace", var, value=self.expression()))
            else:
                keys = self.dotted()
                adds = self.take("+=")
                if not adds:
                    self.need("=")
                out.append(Change("property_add" if adds else "property", var, keys, self.expression()))
        return out

    def where(self) -> tuple | None:
        return self.expression() if self.take("WHERE") else None

    def match(self, optional: bool) -> Match:
        paths = self.paths()
        return Match(paths, self.where(), optional)

    def item(self) -> Item:
        begin = self.at
        value = self.expression()
        spelled = self.spelled(begin)
        return Item(self.name() if self.take("AS") else spelled.strip("`") if value[0] == "var" else spelled, value, spelled)

    def project(self, final: bool) -> Project:
        distinct = self.take("DISTINCT")
        everything, items = self.take("*"), []
        if not everything or self.take(","):
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
        out = Project(final, distinct, everything, items, [], None, None)
        if self.take("ORDER"):
            self.need("BY")
            while not out.order or self.take(","):
                begin = self.at
                value = self.expression()
                one = Item("", value, self.spelled(begin))
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                out.order.append((one, down))
        if self.take("SKIP"):
            out.skip = self.expression()
        if self.take("LIMIT"):
            out.limit = self.expression()
        return out

    def call(self):
        imports = None
        if self.take("("):
            imports = []
            while not self.take(")"):
                imports.append("*" if self.take("*") else self.name())
                self.take(",")
        if self.take("{"):
            query = self.query()
            self.need("}")
            if self.take("IN"):  # batches of a transaction change no result
                self.need("TRANSACTIONS", "OF")
                self.expression()
                self.need("ROWS")
            return Subquery(query, imports)
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args = []
        self.need("(")
        while not self.take(")"):
            args.append(self.expression())
            if not self.sees(")"):
                self.need(",")
        if self.sees("PROCEDURE"):
            self.memory_limit()
        fields, where = None, None
        if self.take("YIELD"):
            fields = []
            while not fields or self.take(","):
                if self.take("*"):
                    fields.append(("*", "*"))
                    continue
                field_name = self.name()
                fields.append((field_name, self.name() if self.take("AS") else field_name))
            where = self.where()
        return Call(name, args, fields, where)

    def load(self) -> Load:
        """LOAD CSV FROM path [WITH CONFIG map] WITH|NO HEADER [IGNORE BAD] [DELIMITER d] [QUOTE q] [NULLIF n] AS row; PARQUET and JSONL without the CSV options."""
        kind = self.name().upper()
        if kind not in ("CSV", "PARQUET", "JSONL"):
            raise SyntaxError(f"cannot load {kind}")
        self.need("FROM")
        source, options = self.expression(), {}
        while not self.take("AS"):
            word = self.name().upper()
            if word == "WITH" and self.take("CONFIG"):
                self.expression()
            elif word in ("WITH", "NO"):
                self.need("HEADER")
                options["header"] = word == "WITH"
            elif word == "IGNORE":
                self.need("BAD")
                options["ignore_bad"] = True
            elif word in ("DELIMITER", "QUOTE", "NULLIF"):
                options[{"DELIMITER": "delimiter", "QUOTE": "quote", "NULLIF": "null_if"}[word]] = self.expression()
            else:
                raise SyntaxError(f"cannot read {word!r} in LOAD")
        return Load(kind, source, options, self.name())

    # patterns

    def paths(self) -> list[Path]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> Path:
        var = None
        if self.peek().kind == "name" and self.sees("=", ahead=1):
            var = self.name()
            self.at += 1
        if self.sees("(") and self.sees("(", ahead=1):  # a bracketed path
            self.at += 1
            parts = self.chain()
            self.need(")")
        else:
            parts = self.chain()
        return Path(var, parts)

    def chain(self, least: int = 0) -> list:
        parts: list = [self.node()]
        while self.sees("-") or self.sees("<") and self.sees("-", ahead=1):
            parts += [self.rel(), self.node()]
        if len(parts) < 1 + 2 * least:
            raise SyntaxError(f"a relationship is expected before {self.peek().text!r}")
        return parts

    def label(self) -> Label:
        t = self.peek()
        if t.kind == "param":
            self.at += 1
            return ("param", t.text[1:])
        name = self.name()
        if not self.sees("."):
            return name
        value: tuple = ("var", name)
        for key in self.dotted():
            value = ("get", value, key)
        return value

    def labels_all(self) -> list[Label]:
        out = []
        while self.take(":"):
            out.append(self.label())
        return out

    def node_labels(self) -> list[list[Label]]:
        out = []
        while self.take(":"):
            some = [self.label()]
            while self.take("|"):
                self.take(":")
                some.append(self.label())
            out.append(some)
        return out

    def props(self) -> tuple[list[tuple[str, tuple]], tuple | None]:
        if self.peek().kind == "param":
            t = self.peek()
            self.at += 1
            return [], ("param", t.text[1:])
        out = []
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.expression()))
                if not self.sees("}"):
                    self.need(",")
        return out, None

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.peek().kind == "name" else None
        labels = self.node_labels()
        props, whole = self.props()
        self.need(")")
        return NodePattern(var, labels, props, whole)

    def lambda_(self) -> Lambda:
        self.need("(")
        names = [self.name()]
        while self.take(","):
            names.append(self.name())
        self.need("|")
        body = self.expression()
        self.need(")")
        if not 2 <= len(names) <= 4:
            raise SyntaxError("a traversal's lambda takes an edge, a node and maybe a path and a weight")
        return Lambda(*(names + [None] * 2)[:4], body)

    def rel(self) -> RelPattern:
        left = self.take("<")
        self.need("-")
        rel = RelPattern(None, [], [], "both")
        if self.take("["):
            if self.peek().kind == "name":
                rel.var = self.name()
            if self.take(":"):
                rel.types.append(self.label())
                while self.take("|"):
                    self.take(":")
                    rel.types.append(self.label())
            if self.take("*"):
                self.expansion(rel)
            rel.props, rel.whole = self.props()
            self.need("]")
        self.need("-")
        right = self.take(">")
        rel.direction = "both" if left == right else "in" if left else "out"
        return rel

    def expansion(self, rel: RelPattern) -> None:
        rel.kind = "walk"
        if self.peek().word in ("BFS", "WSHORTEST", "ALLSHORTEST", "KSHORTEST"):
            rel.kind = self.name().lower()
        if self.peek().kind in ("num", "param"):
            rel.low = rel.high = self.sum()
        if self.take(".."):
            rel.high = self.sum() if self.peek().kind in ("num", "param") else None
        if self.take("|"):
            rel.k = self.sum()
        if self.sees("{") or self.peek().kind == "param":
            rel.props, rel.whole = self.props()
        if self.sees("("):
            first = self.lambda_()
            if rel.kind in ("wshortest", "allshortest"):
                rel.weigh = first
                if self.peek().kind == "name":
                    rel.total = self.name()
                if self.sees("("):
                    rel.keep = self.lambda_()
            else:
                rel.keep = first

    # expressions, by falling precedence

    def expression(self) -> tuple:
        left = self.xor()
        while self.take("OR"):
            left = ("or", left, self.xor())
        return left

    def xor(self) -> tuple:
        left = self.and_()
        while self.take("XOR"):
            left = ("xor", left, self.and_())
        return left

    def and_(self) -> tuple:
        left = self.not_()
        while self.take("AND"):
            left = ("and", left, self.not_())
        return left

    def not_(self) -> tuple:
        return ("not", self.not_()) if self.take("NOT") else self.compare()

    def compare(self) -> tuple:
        first = left = self.predicate()
        parts = []
        while self.peek().kind == "op" and self.peek().text in _COMPARE:
            op = self.peek().text
            self.at += 1
            right = self.predicate()
            parts.append(("compare", "<>" if op == "!=" else op, left, right))
            left = right
        if not parts:
            return first
        out = parts[0]
        for p in parts[1:]:
            out = ("and", out, p)
        return out

    def predicate(self) -> tuple:
        left = self.sum()
        while True:
            if self.take("=~"):
                left = ("matches", left, self.sum())
            elif self.take("IN"):
                left = ("in", left, self.sum())
            elif self.sees("STARTS") or self.sees("ENDS"):
                kind = "startswith" if self.sees("STARTS") else "endswith"
                self.at += 1
                self.need("WITH")
                left = (kind, left, self.sum())
            elif self.take("CONTAINS"):
                left = ("contains", left, self.sum())
            elif self.take("IS"):
                kind = "notnull" if self.take("NOT") else "isnull"
                self.need("NULL")
                left = (kind, left)
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while self.sees("+", "-"):
            op = self.peek().text
            self.at += 1
            left = ("arith", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.power()
        while self.sees("*", "/", "%"):
            op = self.peek().text
            self.at += 1
            left = ("arith", op, left, self.power())
        return left

    def power(self) -> tuple:
        left = self.unary()
        while self.take("^"):
            left = ("arith", "^", left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("negative", self.unary())
        if self.take("+"):
            return self.unary()
        return self.labelled()

    def labelled(self) -> tuple:
        out = self.access(self.atom())
        if self.sees(":") and self.peek(1).kind in ("name", "param"):
            out = ("haslabels", out, self.node_labels())
        return out

    def access(self, out: tuple) -> tuple:
        while True:
            if self.sees(".") and self.peek(1).kind == "name":
                self.at += 1
                out = ("get", out, self.name())
            elif self.take("["):
                low = None if self.sees("..") else self.expression()
                if self.take(".."):
                    high = None if self.sees("]") else self.expression()
                    out = ("slice", out, low, high)
                else:
                    out = ("index", out, low)
                self.need("]")
            else:
                return out

    def atom(self) -> tuple:
        t = self.peek()
        if self.sees("("):
            pattern = self.attempt(lambda: self.chain(1))
            if pattern is not None:
                return ("exists", [Path(None, pattern)], None)
        self.at += 1
        if t.kind == "num":
            if t.text[:2] in ("0x", "0X"):
                return ("value", int(t.text, 16))
            return ("value", int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "str":
            return ("value", re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), t.text[1:-1], flags=re.S))
        if t.kind == "param":
            return ("param", t.text[1:])
        if t.kind == "op" and t.text == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if t.kind == "op" and t.text == "[":
            return self.list_()
        if t.kind == "op" and t.text == "{":
            self.at -= 1
            return ("map", self.props()[0])
        if t.kind != "name":
            raise SyntaxError(f"an expression is expected before {t.text!r}")
        if t.word in ("TRUE", "FALSE", "NULL") and not self.sees("("):
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[t.word])
        if t.word == "CASE":
            return self.case()
        if t.word in ("EXISTS", "COUNT") and self.sees("{"):
            return self.counted(t.word.lower())
        if t.word == "EXISTS" and self.sees("("):
            return self.exists_call()
        if self.sees("("):
            self.at += 1
            return self.function(t.text.strip("`").lower())
        if self.sees("."):  # a module's function
            words, ahead = [t.text], 0
            while self.sees(".", ahead=ahead) and self.peek(ahead + 1).kind == "name":
                words.append(self.peek(ahead + 1).text)
                ahead += 2
            if self.sees("(", ahead=ahead) and len(words) > 1:
                self.at += ahead + 1
                return self.function(".".join(words).lower())
        if self.sees(":") and self.sees(":", ahead=1) and self.peek(2).kind == "name":
            self.at += 2
            return ("enum", t.text.strip("`"), self.name())
        if self.sees("{"):
            projected = self.attempt(lambda: self.projection(t.text.strip("`")))
            if projected is not None:
                return projected
        return ("var", t.text.strip("`"))

    def counted(self, kind: str) -> tuple:
        self.need("{")
        begin = self.at
        paths = self.attempt(lambda: self.bare_pattern())
        if paths is not None:
            return (kind, *paths)
        self.at = begin
        query = self.query()
        self.need("}")
        return (f"{kind}_query", query)

    def bare_pattern(self) -> tuple:
        self.take("MATCH")
        paths = self.paths()
        where = self.where()
        self.need("}")
        return paths, where

    def exists_call(self) -> tuple:
        self.need("(")
        pattern = self.attempt(lambda: self.path())
        if pattern is not None and len(pattern.parts) > 1:
            self.need(")")
            return ("exists", [pattern], None)
        inner = self.expression()
        self.need(")")
        return ("notnull", inner)

    def case(self) -> tuple:
        test = None if self.sees("WHEN") else self.expression()
        branches = []
        while self.take("WHEN"):
            when = self.expression()
            self.need("THEN")
            branches.append((when, self.expression()))
        other = self.expression() if self.take("ELSE") else None
        self.need("END")
        return ("case", test, branches, other)

    def list_(self) -> tuple:
        if self.peek().kind == "name" and self.sees("IN", ahead=1):
            var = self.name()
            self.at += 1
            items = self.expression()
            keep = self.where()
            body = self.expression() if self.take("|") else None
            self.need("]")
            return ("comprehension", var, items, keep, body)
        if self.sees("(") or self.peek().kind == "name" and self.sees("=", ahead=1) and self.sees("(", ahead=2):
            found = self.attempt(self.pattern_comprehension)
            if found is not None:
                return found
        parts = []
        while not self.take("]"):
            parts.append(self.expression())
            if not self.sees("]"):
                self.need(",")
        return ("list", parts)

    def pattern_comprehension(self) -> tuple:
        var = None
        if self.peek().kind == "name":
            var = self.name()
            self.need("=")
        path = Path(var, self.chain(1))
        keep = self.where()
        self.need("|")
        body = self.expression()
        self.need("]")
        return ("rollup", [path], keep, body)

    def projection(self, var: str) -> tuple:
        self.need("{")
        items: list[tuple] = []
        while not self.take("}"):
            if self.take("."):
                items.append(("all",) if self.take("*") else ("key", self.name()))
            else:
                name = self.name()
                items.append(("pair", name, self.expression()) if self.take(":") else ("pair", name, ("var", name)))
            if not self.sees("}"):
                self.need(",")
        return ("projection", ("var", var), items)

    def function(self, name: str) -> tuple:
        """A call; the cursor is past its bracket."""
        if name in _QUANTIFIERS and self.peek().kind == "name" and self.sees("IN", ahead=1):
            var = self.name()
            self.at += 1
            items = self.expression()
            keep = self.where()
            body = self.expression() if self.take("|") else None
            self.need(")")
            if name in ("filter", "extract"):
                return ("comprehension", var, items, keep, body)
            return ("quantifier", name, var, items, keep or ("value", True))
        if name == "reduce":
            acc = self.name()
            self.need("=")
            start = self.expression()
            self.need(",")
            var = self.name()
            self.need("IN")
            items = self.expression()
            self.need("|")
            body = self.expression()
            self.need(")")
            return ("reduce", acc, start, var, items, body)
        if name == "count" and self.take("*"):
            self.need(")")
            return ("call", "count", False, [])
        distinct, args = self.take("DISTINCT"), []
        while not self.take(")"):
            args.append(self.expression())
            if not self.sees(")"):
                self.need(",")
        return ("call", name, distinct, args)


def parse(text: str) -> Query:
    return Parser(text).whole()


def inside(tree: object):
    """Every expression tuple, pattern and clause in a tree, itself first."""
    yield tree
    if isinstance(tree, (tuple, list)):
        for part in tree:
            yield from inside(part)
    elif hasattr(tree, "__dataclass_fields__"):
        for name in tree.__dataclass_fields__:
            yield from inside(getattr(tree, name))
