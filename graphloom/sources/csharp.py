"""Facts from C# source: a recursive-descent parser for a subset of the language, and a binder that turns method bodies into rows.

`facts` reads the documents of one project and gives rows by table (`schema.SCHEMAS`).  Ids are hashes of names, so projects that
are read by different tasks agree on them.  Names that no document declares are library types and methods, which have no bodies.

Bodies are read without regard to flow: every statement's expressions are visited once.  Of a conditional expression only the condition is,
unless `sound_conditional` is set; constructors' calls of others (`: base(...)`), query expressions and anonymous objects are not.
Text that the parser does not know is skipped up to the end of its statement or member.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|\#[^\n]*|(?P<t>@?[A-Za-z_]\w*|\d[\w.]*|[$@]*"(?:\\.|""|[^"\\])*"|'(?:\\.|[^'\\])+'|=>|\?\?|\?\.|&&|\|\||\+\+|--|[-+*/%&|^=!<>]=|::|\S)|\n""", re.S)
MODIFIERS = frozenset("public private protected internal static virtual override abstract sealed async readonly const partial new extern unsafe volatile ref out params this in".split())
VALUES = frozenset("int long short byte sbyte uint ulong ushort char bool float double decimal void DateTime Guid TimeSpan".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^=".split())
BINARY = frozenset("+ - * / % < > <= >= == != && || & | ^ ?? is as".split())


def ident(*parts: object) -> int:
    """A positive id of a name."""
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode()) >> 1


@dataclass
class Method:
    owner: str
    name: str
    params: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # type, name, has a default, is out or ref
    result: str = "void"
    mods: set[str] = field(default_factory=set)
    kind: str = "method"
    generics: int = 0
    body: tuple | None = None
    attributes: list[str] = field(default_factory=list)
    line: int = 0
    text: str = ""
    implicit: bool = False
    library: bool = False
    path: str = ""
    extension: bool = False

    @property
    def key(self) -> str:
        return f"{self.owner}.{self.name}({','.join(p[0] for p in self.params)}){'`' + str(self.generics) if self.generics else ''}"

    @property
    def slot(self) -> str:
        return f"{self.name}/{len(self.params)}/{self.generics}"

    @property
    def id(self) -> int:
        return ident("method", self.key)


@dataclass
class Type:
    name: str
    kind: str
    namespace: str = ""
    bases: list[str] = field(default_factory=list)
    mods: set[str] = field(default_factory=set)
    fields: dict[str, tuple[str, tuple | None, bool]] = field(default_factory=dict)  # type, initializer, static
    properties: dict[str, tuple[str, bool]] = field(default_factory=dict)
    methods: list[Method] = field(default_factory=list)
    signature: Method | None = None  # of a delegate


def tokens(source: str) -> list[tuple[str, int]]:
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if m["t"]:
            out.append((m["t"], line))
    return out


class Parser:
    """Declarations and syntax trees; a tree is a tuple of its kind and its parts."""

    def __init__(self, source: str, path: str = "") -> None:
        self.toks, self.at, self.path, self.types = tokens(source), 0, path, []
        self.toks.append(("", 0))

    def peek(self, k: int = 0) -> str:
        return self.toks[min(self.at + k, len(self.toks) - 1)][0]

    def next(self) -> str:
        t = self.peek()
        self.at = min(self.at + 1, len(self.toks) - 1)
        return t

    def take(self, t: str) -> bool:
        if self.peek() == t:
            self.next()
            return True
        return False

    def skip(self, open_: str, close: str) -> None:
        """Past the bracket that closes the one just read."""
        depth = 1
        while depth and self.peek():
            t = self.next()
            depth += (t == open_) - (t == close)

    def name(self) -> bool:
        return bool(re.match(r"@?[A-Za-z_]", self.peek()))

    # declarations

    def unit(self, namespace: str = "") -> list[Type]:
        while self.peek() and self.peek() != "}":
            if self.take("using") or self.take("extern"):
                while self.peek() and not self.take(";"):
                    self.next()
            elif self.take("namespace"):
                inner = self.dotted()
                if self.take("{"):
                    self.unit(f"{namespace}.{inner}".strip("."))
                    self.take("}")
                else:
                    self.take(";")
                    namespace = inner
            else:
                before = self.at
                self.declaration(namespace, None)
                if self.at == before:
                    self.next()
        return self.types

    def dotted(self) -> str:
        out = self.next()
        while self.peek() == "." and self.next():
            out += "." + self.next()
        return out

    def head(self) -> tuple[list[str], set[str]]:
        attributes, mods = [], set()
        while True:
            if self.peek() == "[":
                self.next()
                while self.peek() and self.peek() != "]":
                    if self.name():
                        a = self.dotted().rpartition(".")[2]
                        attributes.append(a if a.endswith("Attribute") else a + "Attribute")
                    elif self.take("("):
                        self.skip("(", ")")
                    else:
                        self.next()
                self.take("]")
            elif self.peek() in MODIFIERS:
                mods.add(self.next())
            else:
                return attributes, mods

    def type(self) -> str:
        """The name of a type; arrays end in [], generic arguments are kept out of the name."""
        out = self.next().removeprefix("@")
        while self.peek() in (".", "::"):
            self.next()
            out = self.next()
        if self.peek() == "<":
            self.arguments_of_type()
        self.take("?")
        while self.peek() == "[" and self.peek(1) in ("]", ","):
            while self.next() != "]":
                pass
            out += "[]"
        return out

    def arguments_of_type(self) -> list[str]:
        self.next()
        out = []
        while self.peek() and self.peek() != ">":
            if self.take(","):
                continue
            out.append(self.type() if self.name() else self.next())
        self.take(">")
        return out

    def generics(self) -> int:
        return len(self.arguments_of_type()) if self.peek() == "<" else 0

    def declaration(self, namespace: str, owner: Type | None) -> None:
        attributes, mods = self.head()
        start, line = self.at, self.toks[self.at][1]
        kind = self.peek()
        if kind in ("class", "struct", "interface", "enum"):
            self.next()
            t = Type(self.next(), kind.title(), namespace, mods=mods)
            self.generics()
            if self.take(":"):
                while self.peek() not in ("{", "where", ""):
                    t.bases.append(self.type())
                    self.take(",")
            while self.peek() not in ("{", ""):
                self.next()
            self.take("{")
            self.types.append(t)
            if kind == "enum":
                self.skip("{", "}")
                return
            while self.peek() and self.peek() != "}":
                before = self.at
                self.declaration(namespace, t)
                if self.at == before:
                    self.next()
            self.take("}")
            self.take(";")
        elif kind == "delegate":
            self.next()
            result = self.type()
            t = Type(self.next(), "Delegate", namespace, mods=mods)
            self.generics()
            t.signature = Method(t.name, "Invoke", self.parameters()[0], result, library=True)
            self.types.append(t)
            self.take(";")
        elif owner is not None:
            self.member(owner, attributes, mods, start, line)

    def member(self, t: Type, attributes: list[str], mods: set[str], start: int, line: int) -> None:
        if t.kind == "Interface":
            mods = mods | {"abstract", "virtual", "public"}
        m = Method(t.name, "", mods=mods, attributes=attributes, line=line, path=self.path)
        if self.take("~"):
            m.name, m.kind = "Finalize", "destructor"
            self.next()
        elif self.peek() == t.name and self.peek(1) == "(":
            self.next()
            m.name, m.kind = ".cctor" if "static" in mods else ".ctor", "constructor"
        elif self.peek() in ("implicit", "explicit") or self.peek(1) == "operator":
            m.kind = "operator"
            m.result = self.next()
            while self.peek() not in ("(", ""):
                m.name = f"op_{self.next()}"
        else:
            if self.take("event"):
                pass
            m.result = self.type()
            if self.peek() == "this":
                m.name = "Item"
                self.next()
                self.take("[")
                self.skip("[", "]")
            else:
                m.name = self.next().removeprefix("@")
                while self.take("."):
                    m.name = self.next()
            if self.peek() not in ("(", "<"):
                self.values(t, m)
                return
        m.generics = self.generics()
        m.params, m.extension = self.parameters()
        while self.peek() in ("where", ":"):
            while self.peek() not in ("{", "=>", ";", ""):
                if self.next() == "(":
                    self.skip("(", ")")
        m.body = self.body()
        m.text = " ".join(x for x, _ in self.toks[start : self.at])
        t.methods.append(m)

    def values(self, t: Type, m: Method) -> None:
        """Fields and properties."""
        static = bool(m.mods & {"static", "const"})
        if self.peek() in ("{", "=>"):
            t.properties[m.name] = (m.result, static)
            parts = []
            if self.peek() == "=>":
                parts.append(("get", self.body()))
            else:
                self.next()
                while self.peek() and self.peek() != "}":
                    _, own = self.head()
                    word = self.next()
                    if word in ("get", "set"):
                        parts.append((word, self.body()))
                self.take("}")
                if self.take("="):
                    self.expression()
                    self.take(";")
            for word, body in parts:
                own = Method(t.name, f"{word}_{m.name}", [] if word == "get" else [(m.result, "value", False, False)], m.result if word == "get" else "void", set(m.mods), "property", body=body or ("auto", m.name), line=m.line, path=self.path)
                own.text = f"{word} {m.name} {body}"
                t.methods.append(own)
            return
        while True:
            value = self.expression() if self.take("=") else None
            t.fields[m.name] = (m.result, value, static)
            if not self.take(","):
                break
            m.name = self.next()
        self.take(";")

    def parameters(self) -> tuple[list[tuple[str, str, bool, bool]], bool]:
        out, extension = [], False
        self.take("(")
        while self.peek() and not self.take(")"):
            _, mods = self.head()
            extension |= "this" in mods and not out
            kind, name = self.type(), self.next()
            if has := self.take("="):
                self.expression()
            out.append((kind, name, has, bool(mods & {"out", "ref"})))
            self.take(",")
        return out, extension

    def body(self) -> tuple | None:
        if self.take("=>"):
            e = self.expression()
            self.take(";")
            return ("arrow", e)
        if self.peek() == "{":
            return self.statement()
        self.take(";")
        return None

    # statements

    def statement(self) -> tuple:
        t = self.peek()
        line = self.toks[self.at][1]
        if self.take("{"):
            out = []
            while self.peek() and not self.take("}"):
                before = self.at
                out.append(self.statement())
                if self.at == before:
                    self.next()
            return ("block", out)
        if self.take(";"):
            return ("block", [])
        if t in ("if", "while", "lock", "switch", "using", "fixed") and self.peek(1) == "(":
            self.next(), self.next()
            first = self.declared() if t == "using" and self.is_declaration() else ("expr", self.expression())
            self.take(")")
            rest = [first, self.cases() if t == "switch" else self.statement()]
            if t == "if" and self.take("else"):
                rest.append(self.statement())
            return ("block", rest)
        if self.take("do"):
            inner = self.statement()
            self.take("while"), self.take("(")
            e = self.expression()
            self.take(")"), self.take(";")
            return ("block", [inner, ("expr", e)])
        if t == "for" and self.peek(1) == "(":
            self.next(), self.next()
            out = []
            if self.peek() != ";":
                if self.is_declaration():
                    out.append(self.declared())
                else:  # initialisers that declare nothing are not visited
                    self.listed()
            self.take(";")
            condition = [] if self.peek() == ";" else [("expr", self.expression())]
            self.take(";")
            steps = [] if self.peek() == ")" else [("expr", e) for e in self.listed()]
            self.take(")")
            return ("block", [*out, self.statement(), *condition, *steps])
        if t == "foreach":
            self.next(), self.next()
            kind, name = self.type(), self.next()
            self.take("in")
            e = self.expression()
            self.take(")")
            return ("foreach", kind, name, e, self.statement())
        if t in ("try", "finally", "checked", "unchecked", "unsafe", "else") and self.peek(1) == "{":
            self.next()
            return self.statement()
        if self.take("catch"):
            out = []
            if self.take("("):
                kind = self.type()
                if self.name():
                    out.append(("local", kind, self.next(), None))
                self.take(")")
            return ("block", [*out, self.statement()])
        if t in ("return", "throw") or t == "yield":
            self.next()
            if t == "yield":
                self.next()
            e = None if self.peek() == ";" else self.expression()
            self.take(";")
            return ("return", e) if t == "return" else ("expr", e)
        if t in ("break", "continue", "goto"):
            while self.peek() and not self.take(";"):
                self.next()
            return ("block", [])
        if self.name() and self.peek(1) == ":" and self.peek(2) != ":":
            self.next(), self.next()
            return self.statement()
        if self.is_declaration():
            out = self.declared()
            self.take(";")
            return out
        before = self.at
        e = self.expression()
        if self.at == before or not self.take(";"):
            while self.peek() not in (";", "}", ""):
                self.next()
            self.take(";")
        return ("line", line, e)

    def cases(self) -> tuple:
        out = []
        self.take("{")
        while self.peek() and not self.take("}"):
            if self.take("case"):
                out.append(("expr", self.expression()))
                self.take(":")
            elif self.take("default"):
                self.take(":")
            else:
                out.append(self.statement())
        return ("block", out)

    def listed(self) -> list[tuple]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def is_declaration(self) -> bool:
        """Whether a type and a name follow."""
        if not self.name() or self.peek() in ("new", "this", "base", "await", "return", "throw", "typeof", "default"):
            return False
        at = self.at
        self.take("const")
        self.type()
        yes = self.name() and self.peek() not in ("is", "as", "in") and self.peek(1) in ("=", ";", ",", ")")
        self.at = at
        return yes

    def declared(self) -> tuple:
        self.take("const")
        kind, out = self.type(), []
        while True:
            name = self.next()
            out.append(("local", kind, name, self.expression() if self.take("=") else None))
            if not self.take(","):
                return ("block", out)

    # expressions

    def expression(self) -> tuple:
        if (e := self.lambda_()) is not None:
            return e
        left = self.conditional()
        if self.peek() in ASSIGN:
            self.next()
            return ("assign", left, self.expression())
        return left

    def lambda_(self) -> tuple | None:
        at = self.at
        self.take("async")
        names = []
        if self.name() and self.peek(1) == "=>":
            names.append(("", self.next()))
        elif self.take("("):
            while self.peek() not in (")", ""):
                kind = self.type() if self.name() else self.next()
                names.append((kind, self.next()) if self.name() else ("", kind))
                if not self.take(","):
                    break
            if not self.take(")"):
                names = None
        else:
            names = None
        if names is None or not self.take("=>"):
            self.at = at
            return None
        body = self.statement() if self.peek() == "{" else ("arrow", self.expression())
        return ("lambda", names, body)

    def conditional(self) -> tuple:
        e = self.binary()
        if self.take("?"):
            a = self.expression()
            self.take(":")
            return ("choice", e, a, self.expression())
        return e

    def binary(self) -> tuple:
        e = self.unary()
        while self.peek() in BINARY:
            op = self.next()
            if op in ("is", "as"):
                kind = self.type()
                e = ("cast", kind, e) if op == "as" else ("binary", e, ("literal", "bool"))
            else:
                e = ("binary", e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.peek() in ("!", "-", "+", "~", "++", "--", "&", "*"):
            self.next()
            return ("binary", self.unary(), ("literal", "int"))
        if self.take("await"):
            return ("await", self.unary())
        if self.peek() == "(":
            at = self.at
            self.next()
            if self.name():
                kind = self.type()
                if self.take(")") and (self.name() or self.peek() == "(" or re.match(r'["\d$@]', self.peek())) and self.peek() not in BINARY:
                    return ("cast", kind, self.unary())
            self.at = at
        return self.postfix(self.primary())

    def primary(self) -> tuple:
        t = self.next()
        if t == "(":
            e = self.expression()
            self.take(")")
            return e
        if t == "new":
            if self.take("{"):
                self.skip("{", "}")
                return ("unknown",)
            if self.take("["):
                self.skip("[", "]")
                kind = "object[]"
            else:
                kind = self.type()
                if self.take("["):
                    size = [] if self.peek() == "]" else self.listed()
                    self.take("]")
                    kind += "[]"
                    return ("array", kind, size + self.initial())
            if kind.endswith("[]"):
                return ("array", kind, self.initial())
            args = self.arguments() if self.peek() == "(" else []
            return ("new", kind, args, self.initial())
        if t in ("typeof", "default", "sizeof", "nameof") and self.take("("):
            self.skip("(", ")")
            return ("literal", "object")
        if t == "delegate":
            if self.take("("):
                self.skip("(", ")")
            if self.take("{"):
                self.skip("{", "}")
            return ("unknown",)
        if t == "null":
            return ("literal", "null")
        if t in ("true", "false"):
            return ("literal", "bool")
        if re.match(r'[$@]*"', t):
            return ("literal", "string")
        if re.match(r"[\d']", t):
            return ("literal", "int")
        return ("id", t.removeprefix("@"), self.type_arguments())

    def initial(self) -> list[tuple]:
        """The expressions of an initializer in braces."""
        out = []
        if self.take("{"):
            while self.peek() and not self.take("}"):
                if self.peek() == "{":
                    out += self.initial()
                else:
                    out.append(self.expression())
                if not self.take(",") and self.peek() != "}":
                    self.next()
        return out

    def type_arguments(self) -> int:
        """How many type arguments a call names here."""
        if self.peek() != "<":
            return 0
        at, n = self.at, 0
        self.next()
        while self.name():
            self.type()
            n += 1
            if not self.take(","):
                break
        if n and self.take(">") and self.peek() == "(":
            return n
        self.at = at
        return 0

    def arguments(self) -> list[tuple[str, tuple]]:
        """(name, expression) of each; the name is empty for those by place."""
        out = []
        self.take("(")
        while self.peek() and not self.take(")"):
            name = ""
            if self.name() and self.peek(1) == ":" and self.peek(2) != ":":
                name = self.next()
                self.next()
            while self.peek() in ("ref", "out", "in"):
                self.next()
            if self.is_declaration() and self.peek(1) not in (",", ")"):
                self.type()
            out.append((name, self.expression()))
            if not self.take(",") and self.peek() != ")":
                break
        return out

    def postfix(self, e: tuple) -> tuple:
        while True:
            t = self.peek()
            line = self.toks[self.at][1]
            if t in (".", "?.", "::"):
                self.next()
                e = ("member", e, self.next(), self.type_arguments())
            elif t == "(":
                e = ("call", e, self.arguments(), line)
            elif t == "[":
                self.next()
                e = ("index", e, self.listed())
                self.take("]")
            elif t in ("++", "--"):
                self.next()
            else:
                return e


@dataclass
class Value:
    """What an expression is: a node, or something that a target takes in another way (an allocation, a method, a call's result)."""

    type: str = ""
    node: int | None = None
    alloc: str = ""
    method: Method | None = None
    receiver: int | None = None
    call: list | None = None


class Binder:
    """Rows of one project's types and methods."""

    def __init__(self, types: list[Type], assembly: str, sound_conditional: bool = False) -> None:
        self.assembly, self.sound = assembly, sound_conditional
        self.types: dict[str, Type] = {}
        for t in types:
            if (old := self.types.get(t.name)) is None:
                self.types[t.name] = t
            else:  # a part of the same type
                old.bases += t.bases
                old.methods += t.methods
                old.fields |= t.fields
                old.properties |= t.properties
        self.rows: dict[str, list[tuple]] = {k: [] for k in ("types", "interfaces", "methods", "attributes", "nodes", "allocs", "assigns", "delegates", "callsites", "args")}
        self.libraries: dict[str, Type] = {}
        self.stubs: dict[str, Method] = {}

    def run(self) -> dict[str, list[tuple]]:
        for t in list(self.types.values()):
            if t.kind == "Class" and "static" not in t.mods and not any(m.kind == "constructor" and "static" not in m.mods for m in t.methods):
                t.methods.append(Method(t.name, ".ctor", mods={"public"}, kind="constructor", implicit=True))
        for t in list(self.types.values()):
            for m in list(t.methods):
                Body(self, t, m).run()
        for t in self.types.values():
            self.declare(t, False)
        for t in self.libraries.values():
            self.declare(t, True)
        for m in self.stubs.values():
            self.method(m)
            self.interface(m)
        return self.rows

    def type_id(self, name: str) -> int:
        if name not in self.types and name not in self.libraries:
            self.libraries[name] = Type(name, "Delegate" if is_delegate(name) else "Struct" if name in VALUES else "Class")
        return ident("type", name)

    def declare(self, t: Type, library: bool) -> None:
        base = next((b for b in t.bases if t.kind == "Class" and self.kind(b) != "Interface"), None)
        faces = [b for b in t.bases if b != base]
        access = "Public" if "public" in t.mods or library else "Internal"
        self.rows["types"].append((ident("type", t.name), self.assembly, t.namespace, t.name, t.kind, tracked(t.name) and t.kind not in ("Struct", "Enum"), access, library, ident("type", base) if base and base in self.types else None))
        self.rows["interfaces"] += [(ident("type", t.name), ident("type", x)) for x in faces if x in self.types]
        for m in t.methods:
            self.method(m)

    def kind(self, name: str) -> str:
        return self.types[name].kind if name in self.types else "Interface" if re.match(r"I[A-Z]", name) else "Class"

    def method(self, m: Method) -> None:
        abstract = "abstract" in m.mods or (m.body is None and not m.implicit and not m.library)
        virtual = bool(m.mods & {"virtual", "abstract", "override"})
        access = next((x.title() for x in ("public", "protected", "internal") if x in m.mods), "Private")
        self.rows["methods"].append((m.id, self.type_id(m.owner), m.name, m.slot, "static" in m.mods, virtual, abstract, "override" in m.mods, m.implicit, access, m.kind, len(m.params), m.generics, self.type_id(m.result), m.result == "void", not m.library and not abstract, m.path, m.line, m.text))
        self.rows["attributes"] += [(m.id, a) for a in m.attributes]

    def node(self, m: Method, name: str, kind: str, node_kind: str, position: int | None = None) -> int:
        node = ident("node", m.key, name, node_kind)
        self.rows["nodes"].append((node, m.id, name, self.type_id(kind or "object"), node_kind, position))
        return node

    def interface(self, m: Method) -> dict[str, int]:
        """The nodes of a method's parameters by name, its receiver and its result."""
        out = {}
        for k, (kind, name, _, _) in enumerate(m.params):
            if self.is_tracked(kind, m):
                out[name] = self.node(m, f"P_{k}" if m.library else name, kind, "parameter", k)
        if "static" not in m.mods:
            out["this"] = self.node(m, "this", m.owner, "this")
        if m.result != "void" and self.is_tracked(m.result, m):
            out["return"] = self.node(m, "return", m.result, "return")
        return out

    def is_tracked(self, kind: str, m: Method | None = None) -> bool:
        return tracked(kind) and not (kind in self.types and self.types[kind].kind in ("Struct", "Enum"))

    def chain(self, name: str) -> Iterator[Type]:
        """A type and those above it, its own classes first."""
        seen, todo = set(), [name]
        while todo:
            x = todo.pop(0)
            if x in seen or x not in self.types:
                continue
            seen.add(x)
            yield self.types[x]
            todo += self.types[x].bases

    def lookup(self, owner: str, name: str, args: list[tuple[str, Value]], generics: int = 0) -> Method | None:
        """The method that a call means: the nearest type's, with parameters for all arguments; of several, the one whose types fit best."""
        for t in self.chain(owner):
            fit = []
            for m in t.methods:
                names = [p[1] for p in m.params]
                given = {names.index(n) if n in names else len(names) for n, _ in args if n} | set(range(sum(not n for n, _ in args)))
                if m.name == name and all(k < len(names) for k in given) and all(k in given or p[2] for k, p in enumerate(m.params)):
                    score = sum(self.distance(v.type, m.params[names.index(n) if n else k][0], m) for k, (n, v) in enumerate(args))
                    fit.append((score, (generics or m.generics) != m.generics, m.generics > 0, m.key, m))
            if fit:
                return min(fit, key=lambda x: x[:4])[4]
        return None

    def distance(self, have: str, want: str, m: Method) -> int:
        if have == want:
            return 0
        if m.generics and want not in self.types and len(want) <= 2:
            return 1
        above = [t.name for t in self.chain(have)]
        return 2 if want in above else 3 if want == "object" or not have else 9

    def extension(self, receiver: str, name: str, n: int) -> Method | None:
        above = {receiver, "object", *(t.name for t in self.chain(receiver))}
        return next((m for t in self.types.values() for m in t.methods if m.extension and m.name == name and len(m.params) == n + 1 and m.params[0][0] in above), None)

    def stub(self, owner: str, name: str, n: int, static: bool) -> Method:
        """A library's method, known by its name and its number of parameters."""
        m = Method(owner or "object", name, [("object", f"p{k}", False, False) for k in range(n)], "object", {"public"} | ({"static"} if static else set()), library=True)
        self.type_id(m.owner)
        return self.stubs.setdefault(m.key, m)


def is_delegate(name: str) -> bool:
    return name in ("Action", "Func", "Predicate", "EventHandler", "Comparison", "Delegate")


def tracked(name: str) -> bool:
    return name not in VALUES


class Body:
    """The rows of one method's body."""

    def __init__(self, b: Binder, t: Type, m: Method, outer: Body | None = None) -> None:
        self.b, self.t, self.m, self.outer = b, t, m, outer
        self.ordinal = self.temporaries = self.lambdas = 0
        self.locals: dict[str, tuple[str, int | None]] = {}
        self.ends = b.interface(m)
        for kind, name, _, _ in m.params:
            self.locals[name] = (kind, self.ends.get(name))
        self.line = m.line

    def run(self) -> None:
        if self.m.kind == "constructor":
            static = "static" in self.m.mods
            for name, (_, value, own) in self.t.fields.items():
                if value is not None and own == static:
                    self.assign(self.field(self.t, name), self.value(value))
        if self.m.body is not None:
            self.statement(self.m.body)

    # rows

    def temporary(self, kind: str, node_kind: str = "variable") -> int:
        self.temporaries += 1
        return self.b.node(self.m, f"T_{self.temporaries}", kind, node_kind)

    def field(self, t: Type, name: str) -> Value:
        for own in self.b.chain(t.name):
            if name in own.fields:
                kind = own.fields[name][0]
                node_kind = "delegate" if self.delegate(kind) else "field"
                return Value(kind, self.b.node(self.m, f"{own.name}.{name}", kind, node_kind) if self.b.is_tracked(kind) else None)
        return Value()

    def delegate(self, kind: str) -> bool:
        return is_delegate(kind) or kind in self.b.types and self.b.types[kind].kind == "Delegate"

    def assign(self, to: Value, v: Value) -> None:
        if v.node is None and v.call is not None and to.node is not None:
            v.call[6] = v.node = to.node  # the target takes the place of the call's result
        elif to.node is None:
            return
        elif v.method is not None:
            self.b.rows["delegates"].append((self.m.id, to.node, v.method.id))
            if v.receiver is not None:
                self.b.rows["assigns"].append((self.m.id, v.receiver, to.node))
        elif v.alloc:
            self.b.rows["allocs"].append((self.m.id, to.node, self.b.type_id(v.alloc)))
        elif v.node is not None and v.node != to.node:
            self.b.rows["assigns"].append((self.m.id, v.node, to.node))

    def node(self, v: Value) -> int | None:
        """The node that holds a value; calls and methods get a temporary."""
        if v.node is None and v.method is not None:
            v.node = self.temporary("Delegate", "delegate")
            self.assign(Value(node=v.node), Value(method=v.method, receiver=v.receiver))
        elif v.node is None and v.call is not None and v.type != "void" and tracked(v.type):
            v.node = v.call[6] = self.temporary(v.type, "call")
        return v.node

    def site(self, kind: str, callee: Method | None, args: list[int | None], receiver: int | None, ordinal: int, delegate: int | None = None, lhs: int | None = None) -> list:
        row = [self.m.id, ordinal, kind, callee.id if callee else None, delegate, receiver, lhs, self.line]
        self.b.rows["callsites"].append(row)
        self.b.rows["args"] += [(self.m.id, ordinal, k, a) for k, a in enumerate(args)]
        return row

    def count(self) -> int:
        self.ordinal += 1
        return self.ordinal

    # statements

    def statement(self, s: tuple) -> None:
        kind = s[0]
        if kind == "block":
            for x in s[1]:
                self.statement(x)
        elif kind == "local":
            self.local(s[1], s[2], self.value(s[3]) if s[3] else None)
        elif kind == "foreach":
            v = self.value(s[3])
            to = self.local(s[1] if s[1] != "var" else v.type.removesuffix("[]") or "object", s[2], None)
            if (n := self.node(v)) is not None:
                self.assign(to, Value(v.type, n))
            self.statement(s[4])
        elif kind in ("return", "arrow"):
            v = self.value(s[1]) if s[1] else Value()
            if "return" in self.ends:
                self.assign(Value(self.m.result, self.ends["return"]), v)
        elif kind == "auto":
            f = Value(self.t.properties[s[1]][0], self.b.node(self.m, f"{self.t.name}.{s[1]}", self.t.properties[s[1]][0], "property"))
            if "return" in self.ends:
                self.assign(Value(self.m.result, self.ends["return"]), f)
            elif self.m.params and self.m.params[0][1] in self.ends:
                self.assign(f, Value(f.type, self.ends[self.m.params[0][1]]))
        elif kind == "line":
            self.line = s[1]
            self.value(s[2])
        elif s[1]:
            self.value(s[1])

    def local(self, kind: str, name: str, v: Value | None) -> Value:
        if kind in ("var", "dynamic"):
            kind = (v.type if v else "") or "object"
        to = Value(kind, self.b.node(self.m, name, kind, "delegate" if self.delegate(kind) else "variable") if self.b.is_tracked(kind) else None)
        self.locals[name] = (kind, to.node)
        if v is not None:
            self.assign(to, v)
        return to

    # expressions

    def value(self, e: tuple) -> Value:
        return getattr(self, f"_{e[0]}")(*e[1:])

    def _unknown(self) -> Value:
        return Value()

    def _literal(self, kind: str) -> Value:
        return Value("" if kind == "null" else kind)

    def _binary(self, a: tuple, b: tuple) -> Value:
        self.value(a)
        self.value(b)
        return Value("bool")

    def _choice(self, c: tuple, a: tuple, b: tuple) -> Value:
        self.value(c)
        if not self.b.sound:
            return Value()
        one, other = self.value(a), self.value(b)
        out = Value(one.type or other.type, self.temporary(one.type or other.type))
        self.assign(out, one)
        self.assign(out, other)
        return out

    def _cast(self, kind: str, e: tuple) -> Value:
        v = self.value(e)
        return Value(kind, self.node(v), v.alloc, v.method, v.receiver)

    def _await(self, e: tuple) -> Value:
        return self.value(e)

    def _index(self, e: tuple, at: list[tuple]) -> Value:
        for x in at:
            self.value(x)
        v = self.value(e)
        return Value(v.type.removesuffix("[]"), self.node(v))

    def _array(self, kind: str, parts: list[tuple]) -> Value:
        node = self.temporary(kind)
        self.b.rows["allocs"].append((self.m.id, node, self.b.type_id(kind)))
        for x in parts:
            v = self.value(x)
            if self.b.is_tracked(v.type) and self.node(v) is not None:
                self.assign(Value(kind, node), Value(v.type, v.node))
        return Value(kind, node, kind)

    def _lambda(self, names: list[tuple[str, str]], body: tuple) -> Value:
        self.lambdas += 1
        static = "static" in self.m.mods
        m = Method(self.m.owner, f"{self.m.name}#{self.lambdas}", [(k or "object", n, False, False) for k, n in names], "object", {"static"} if static else set(), "lambda", body=body, line=self.line, path=self.m.path)
        m.text = str(body)
        self.t.methods.append(m)
        inner = Body(self.b, self.t, m, self)
        inner.run()
        return Value("Func", method=m, receiver=None if static else self.ends.get("this"))

    def _assign(self, left: tuple, right: tuple) -> Value:
        if (p := self.property(left)) is not None:
            ordinal = self.count()
            owner, receiver, kind, static = p
            v = self.value(right)
            if setter := self.b.lookup(owner, f"set_{left[1] if left[0] == 'id' else left[2]}", [("", v)]):
                self.site("property", setter, [self.node(v)], receiver, ordinal)
            return v
        to = self.value(left)
        v = self.value(right)
        self.assign(to, v)
        return v

    def property(self, e: tuple) -> tuple[str, int | None, str, bool] | None:
        """(owner, receiver, type, static) if e names a property."""
        if e[0] == "id" and e[1] not in self.locals:
            for t in self.b.chain(self.t.name):
                if e[1] in t.properties:
                    kind, static = t.properties[e[1]]
                    return self.t.name, None if static else self.ends.get("this"), kind, static
        if e[0] == "member":
            owner, receiver, _ = self.receiver(e[1])
            for t in self.b.chain(owner):
                if e[2] in t.properties:
                    kind, static = t.properties[e[2]]
                    return owner, None if static else receiver, kind, static
        return None

    def receiver(self, e: tuple) -> tuple[str, int | None, bool]:
        """(type, node, whether it is a type's name)."""
        if e[0] == "id":
            if e[1] == "base":
                base = next((b for b in self.t.bases if self.b.kind(b) != "Interface"), "object")
                return base, self.ends.get("this"), False
            if e[1] not in self.locals and not self.known(e[1]):
                return e[1], None, True
        if e[0] == "member" and e[1][0] == "id" and e[1][1] not in self.locals and not self.known(e[1][1]) and e[1][1] not in self.b.types:
            return e[2], None, True  # a type with its namespace
        v = self.value(e)
        return v.type, self.node(v), False

    def known(self, name: str) -> bool:
        if name == "this" or any(name in t.fields or name in t.properties for t in self.b.chain(self.t.name)):
            return True
        return bool(self.outer and (name in self.outer.locals or self.outer.known(name)))

    def get(self, owner: str, name: str, receiver: int | None, kind: str) -> Value:
        ordinal = self.count()
        getter = self.b.lookup(owner, f"get_{name}", [])
        return Value(kind, call=self.site("property", getter, [], receiver, ordinal)) if getter else Value(kind)

    def _id(self, name: str, generics: int = 0) -> Value:
        if name in self.locals:
            kind, node = self.locals[name]
            return Value(kind, node)
        if name in ("this", "base"):
            return Value(self.t.name, self.ends.get("this"))
        scope = self.outer
        while scope:  # a variable that a lambda takes from outside, in the lambda's own graph
            if name in scope.locals:
                kind, node = scope.locals[name]
                self.locals[name] = (kind, self.b.node(self.m, name, kind, "variable") if node is not None else None)
                return Value(*self.locals[name])
            scope = scope.outer
        for t in self.b.chain(self.t.name):
            if name in t.fields:
                return self.field(self.t, name)
            if name in t.properties:
                kind, static = t.properties[name]
                return self.get(self.t.name, name, None if static else self.ends.get("this"), kind)
            for m in t.methods:
                if m.name == name:
                    return Value("Func", method=m, receiver=None if "static" in m.mods else self.ends.get("this"))
        return Value(name if name in self.b.types else "")

    def _member(self, e: tuple, name: str, generics: int = 0) -> Value:
        owner, receiver, static = self.receiver(e)
        for t in self.b.chain(owner):
            if name in t.fields:
                return self.field(t, name)
            if name in t.properties:
                return self.get(owner, name, receiver, t.properties[name][0])
            for m in t.methods:
                if m.name == name:
                    return Value("Func", method=m, receiver=None if "static" in m.mods else receiver)
        return Value("")

    def bound(self, m: Method, args: list[tuple[str, Value]]) -> list[int | None]:
        """The nodes of the arguments by parameter; null where none is given or none is tracked."""
        names = [p[1] for p in m.params]
        out: dict[int, int | None] = {}
        for k, (n, v) in enumerate(args):
            out[names.index(n) if n in names else k] = self.node(v) if v.node is not None or v.method or v.call or v.alloc else None
        return [out.get(k) for k in range(max(out, default=-1) + 1)]

    def _new(self, kind: str, args: list[tuple[str, tuple]], initial: list[tuple]) -> Value:
        ordinal = self.count()
        node = self.temporary(kind)
        self.b.rows["allocs"].append((self.m.id, node, self.b.type_id(kind)))
        if self.delegate(kind) and args:  # a delegate's constructor takes a method
            v = self.value(args[0][1])
            return Value(kind, None, "", v.method, v.receiver) if v.method else v
        values = [(n, self.value(x)) for n, x in args]
        ctor = self.b.lookup(kind, ".ctor", values) if kind in self.b.types and any(m.name == ".ctor" for m in self.b.types[kind].methods) else None
        ctor = ctor or self.b.stub(kind, ".ctor", len(values), False)
        self.site("ctor", ctor, self.bound(ctor, values), node, ordinal, lhs=node)
        out = Value(kind, node, kind)
        for x in initial:
            if x[0] == "assign" and x[1][0] == "id":
                self.member_of(out, x[1][1], x[2])
            else:
                self.value(x)
        return out

    def member_of(self, of: Value, name: str, e: tuple) -> None:
        for t in self.b.chain(of.type):
            if name in t.properties:
                ordinal, v = self.count(), self.value(e)
                if setter := self.b.lookup(of.type, f"set_{name}", [("", v)]):
                    self.site("property", setter, [self.node(v)], of.node, ordinal)
                return
            if name in t.fields:
                self.assign(self.field(t, name), self.value(e))
                return
        self.value(e)

    def _call(self, f: tuple, args: list[tuple[str, tuple]], line: int) -> Value:
        self.line = line or self.line
        if f[0] == "member" and f[2] == "Invoke":
            f = f[1]
        owner, receiver, static, name, generics = self.t.name, self.ends.get("this"), False, "", 0
        if f[0] == "id":
            name, generics = f[1], f[2]
            found = self.locals.get(name) or next(((t.fields[name][0], None) for t in self.b.chain(self.t.name) if name in t.fields), None)
            if found or (self.outer and self.known(name)):
                return self.through(self.value(f), args)
        elif f[0] == "member":
            owner, receiver, static = self.receiver(f[1])
            name, generics = f[2], f[3]
            if any(name in t.fields for t in self.b.chain(owner)):
                return self.through(self.value(f), args)
        else:
            return self.through(self.value(f), args)
        values = [(n, self.value(x)) for n, x in args]
        m = self.b.lookup(owner, name, values, generics)
        if m is None and not static and (x := self.b.extension(owner, name, len(values))):
            first = Value(owner, receiver)
            return self.result(x, [("", first), *values], None)
        if m is None:
            m = self.b.stub("Object" if owner in self.b.types else owner, name, len(values), static)
        return self.result(m, values, None if "static" in m.mods else receiver)

    def result(self, m: Method, values: list[tuple[str, Value]], receiver: int | None) -> Value:
        nodes = self.bound(m, values)
        ordinal = self.count()
        kind = "static" if "static" in m.mods else "virtual" if m.mods & {"virtual", "abstract", "override"} else "instance"
        return Value(m.result, call=self.site(kind, m, nodes, receiver, ordinal))

    def through(self, v: Value, args: list[tuple[str, tuple]]) -> Value:
        """A call of a delegate."""
        values = [(n, self.value(x)) for n, x in args]
        nodes = [self.node(x) for _, x in values]
        own = self.b.types[v.type].signature if v.type in self.b.types else None
        return Value(own.result if own else "object", call=self.site("delegate", None, nodes, None, self.count(), delegate=self.node(v)))


def facts(sources: list[tuple[str, str]], assembly: str = "MyProject", sound_conditional: bool = False) -> dict[str, list[tuple]]:
    """Rows by table of the documents (path, source) of one project."""
    types = [t for path, source in sources for t in Parser(source, path).unit()]
    rows = Binder(types, assembly, sound_conditional).run()
    return {k: list(dict.fromkeys(map(tuple, v))) for k, v in rows.items()}
