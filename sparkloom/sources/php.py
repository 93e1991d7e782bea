"""PHP sources to rows: scan of folders, and a tagged-row extraction per file in Arrow batches.

One row per declaration, hierarchy edge, import, reference, variable mark, scope, typed expression, argument list and argument;
files are independent, so the scan runs on as many tasks as there are splits and a file that does not parse gives what was
read before the fault, and an ``error`` row.

A row with tag ``expr`` is a node of an expression that may have types: ``seq`` names it in its file, ``value`` is the node whose
types it starts from (the object of an access, the last value of a variable, the collection of a loop), ``types`` are those that
the text itself states.  Plans follow these links; the extraction resolves nothing but names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

SCHEMA = (
    "uri string, tag string, kind string, name string, fqn string, owner string, namespace string, types string, value string, description string, deprecated string, "
    "visibility int, is_static boolean, modifier string, start_line int, start_char int, end_line int, end_char int, seq long"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Places of the columns in a row, which is a list while its file is read.
URI, TAG, KIND, NAME, FQN, OWNER, NAMESPACE, TYPES, VALUE, DESCRIPTION, DEPRECATED, VISIBILITY, IS_STATIC, MODIFIER, START_LINE, START_CHAR, END_LINE, END_CHAR, SEQ = range(len(COLUMNS))
#: Rows that a task holds before it hands them on.
HELD = 20_000
#: Files that make a task where their places do not say: some seconds of work.
PER_TASK = 10_000
#: Words of the language that are never names.
KEYWORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public require require_once return static switch throw trait try unset use var while xor yield".split()
)
NATIVES, RELATIVE, PARENT = frozenset(N.NATIVES), frozenset(N.RELATIVE), frozenset(N.PARENT)  # plain values: workers need no other module
MAGIC = {"self", "static", "parent", "$this"}
#: What most tokens are stands first: no other alternative starts with their characters, and no repeat that is followed by others gives a character back.
LEX = re.compile(
    r"""(?:[\x20\t\n\r]\s*+)?+(?:(?P<name>\\?[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*+(?:\\[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*+)*+\\?)|(?P<mark>[;{}(),\[\]])"""
    r"""|(?P<var>\$[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*+)|(?P<doc>/\*\*.*?(?:\*/|\Z))|(?P<comment>/\*.*?(?:\*/|\Z)|//(?:(?!\?>)[^\r\n])*|\#(?!\[)(?:(?!\?>)[^\r\n])*)|(?P<close>\?>)"""
    r"""|(?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<id>[A-Za-z_]\w*)(?P=q)\r?\n.*?^[ \t]*(?P=id)\b)|(?P<string>'(?:[^'\\]|\\.)*(?:'|\Z)|"(?:[^"\\]|\\.)*(?:"|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z))"""
    r"""|(?P<number>\d[\w.]*)|(?P<space>\s+|\Z)|(?P<op>\?->|->|::|=>|\.\.\.|\*\*=?|<=>|===?|!==?|<=|>=|&&|\|\||\?\?=?|[-+*/.%&|^]=|\+\+|--|\#\[|.))""",
    re.S | re.M | re.X,
)
LINE = re.compile(r"\r\n|\n|\r")
BEGIN = re.compile(r"<\?(?:php\b|=)?", re.I)
#: Words that may start a statement of their own kind.
STARTS = frozenset("namespace use abstract final readonly class interface trait enum function const define global".split())
#: Nodes with an argument list of their own.
CALLS = {"function", "method", "static_method", "new"}
DOC_TAG = re.compile(r"@([\w-]+)[ \t]*([^\n]*)")


def scan(spark: SparkSession, folder: str, scheme: str | None = None) -> DataFrame:
    """(uri, content, sha1) of every .php file below a folder; bytes are not decoded here.

    With a scheme the files are bundled sources: their uris are the scheme and the path below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.php").load(folder)
    uri = F.col("path")
    if scheme:
        uri = F.concat(F.lit(scheme + "://"), F.regexp_extract("path", re.escape("/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/") + "(.*)", 1))
    return files.select(uri.alias("uri"), "content", F.sha1("content").alias("sha1"))


class Token:
    __slots__ = ("end", "kind", "start", "text")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        begin = BEGIN.search(text, at)
        if not begin:
            break
        at = begin.end()
        for m in LEX.finditer(text, at):
            at, kind = m.end(), m.lastgroup
            if kind == "mark":
                out.append(Token("op", text[at - 1], at - 1, at))
            elif kind == "close":
                out.append(Token("op", ";", at - 2, at))
                break
            elif kind != "comment" and kind != "space":
                out.append(Token(kind, m[kind], m.start(kind), at))
        else:
            break
    return out


class Doc:
    """Tags of a doc comment."""

    def __init__(self, text: str):
        plain = re.sub(r"^[ \t]*\*[ \t]?", "", text[3:-2] if text.endswith("*/") else text[3:], flags=re.M)
        self.tags = DOC_TAG.findall(plain)
        self.description = " ".join(plain.split("@")[0].split())

    def first(self, name: str) -> str | None:
        return next((v.strip() for t, v in self.tags if t == name), None)

    def types(self, name: str) -> str | None:
        v = self.first(name)
        return v.split()[0] if v else None


class Extractor:
    """One file. Names are resolved against the imports and namespace in force where they stand."""

    def __init__(self, uri: str, text: str):
        self.uri, self.text, self.t, self.i, self.rows = uri, text, lex(text), 0, []
        self.n = len(self.t)
        self.end = Token("end", "", len(text), len(text))
        self.lines = [0, *[m.end() for m in LINE.finditer(text)], sys.maxsize]
        self.namespace, self.imports, self.doc = "", {"class": {}, "function": {}, "const": {}}, None
        self.owner, self.parent, self.scope = "", "", 0
        self.last, self.open, self.due, self.loose = None, [], [], False  # the node just read, open brackets, assignments, an operator since the last statement
        self.versions: dict[int, dict[str, tuple]] = {}  # of each scope and variable: node it has its types from, types stated
        self.place: tuple[str, Token | None, Token | None] = ("open", None, None)  # what a new import goes after

    # tokens
    def peek(self, k: int = 0) -> Token:
        at = self.i + k
        return self.t[at] if at < self.n else self.end

    def next(self) -> Token:
        at = self.i
        self.i = at + 1
        return self.t[at] if at < self.n else self.end

    def take(self, *texts: str) -> bool:
        token = self.t[self.i] if self.i < self.n else self.end
        if token.kind != "string" and token.text.lower() in texts:
            self.i += 1
            return True
        return False

    def position(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, at) - 1
        return line, at - self.lines[line]

    def row(self, tag: str, kind: str, name: str, token: Token, end: Token | None = None, *, fqn=None, owner=None, types=None, value=None, description=None, deprecated=None, visibility=None, is_static=None, modifier=None) -> list:
        lines, rows, start, stop = self.lines, self.rows, token.start, (end or token).end
        first = last = bisect.bisect_right(lines, start) - 1
        if stop >= lines[first + 1]:
            last = bisect.bisect_right(lines, stop) - 1
        row = [
            self.uri, tag, kind, name, fqn, self.owner if owner is None else owner, "\\" + self.namespace, types, value, description, deprecated,
            visibility, is_static, modifier, first, start - lines[first], last, stop - lines[last], len(rows),
        ]
        rows.append(row)
        return row

    # names
    def fqn(self, short: str) -> str:
        return "\\" + (self.namespace + "\\" if self.namespace else "") + short

    def class_name(self, name: str) -> str:
        low = name.lower()
        if low in RELATIVE or low in PARENT:
            return (self.parent if low in PARENT else self.owner) or name
        if name.startswith("\\") or low in NATIVES:
            return name
        head, _, rest = name.partition("\\")
        if (full := self.imports["class"].get(head.lower())) is not None:
            self.row("use", "class", head, self.peek(-1))
            return full + ("\\" + rest if rest else "")
        return self.fqn(name)

    def other_names(self, name: str, kind: str) -> list[str]:
        """All names that a function or constant may have, most likely first."""
        if name.startswith("\\"):
            return [name]
        head, _, rest = name.partition("\\")
        if rest:
            return [self.class_name(head) + "\\" + rest]
        key = name.lower() if kind == "function" else name
        if key in self.imports[kind]:
            self.row("use", kind, name, self.peek(-1))
            return [self.imports[kind][key]]
        return list(dict.fromkeys(["\\" + name, self.fqn(name)]))

    def type_list(self, text: str | None, late: bool = False) -> str | None:
        """Resolved names of a type text; late: those that stand for the class of the access stay."""
        if not text:
            return None
        out = []
        for t in re.split(r"[|&]", text.lstrip("?").strip("()")):
            base = re.sub(r"(\[\])+$", "", t)
            if late and base in ("static", "$this"):
                out.append(t)
            elif re.fullmatch(r"\\?[\w\\\x80-\U0010ffff$]+", base):
                out.append(self.class_name(base) + t[len(base) :])
        return "|".join(dict.fromkeys(out)) or None

    def take_doc(self) -> Doc | None:
        doc, self.doc = self.doc, None
        return doc

    def documented(self, doc: Doc | None) -> dict:
        return {"description": doc.description or None, "deprecated": doc.first("deprecated")} if doc else {}

    # grammar
    def run(self) -> list[list]:
        self.row("scope", "file", "", Token("op", "", 0, len(self.text)), value="0")
        begin = BEGIN.search(self.text)
        if begin:
            self.place = ("open", None, Token("op", "", begin.start(), begin.end()))
        try:
            self.statements(None)
        except RecursionError:
            self.row("error", "depth", "", self.peek())
        kind, first, last = self.place
        if last:
            line = self.lines[self.position((first or last).start)[0]]
            self.row("insert", kind, "", last, value=self.text[line : (first or last).start] if first else "", description="\r\n" if "\r\n" in self.text else "\n")
        return self.rows

    def statements(self, close: str | None) -> None:
        while (token := self.peek()).kind != "end":
            if token.text == "}" and token.kind == "op":
                self.i += 1
                if close:
                    return
                self.row("error", "syntax", "}", token)
                continue
            self.statement()
        if close:
            self.row("error", "syntax", close, self.peek())

    def statement(self) -> None:
        token = self.peek()
        if token.kind == "doc":
            self.doc = Doc(self.next().text)
            return
        if token.kind == "name" and (word := token.text.lower()) in STARTS and self.peek(-1).text not in ("->", "?->", "::"):
            after = self.peek(1)
            if word == "namespace" and (after.kind == "name" or after.text == "{"):
                first = self.next()
                self.namespace = self.next().text.strip("\\") if self.peek().kind == "name" else ""
                self.imports = {"class": {}, "function": {}, "const": {}}
                self.row("namespace", "namespace", self.namespace, self.peek(-1), fqn="\\" + self.namespace)
                self.place = ("namespace", first, self.peek())
                if self.take("{"):
                    self.statements("}")
                return
            if word == "use" and not self.owner:
                return self.use()
            if word in ("abstract", "final", "readonly") and after.kind == "name":
                self.i += 1
                if self.peek().text.lower() == "class":
                    self.class_like(word)
                return
            if word in ("class", "interface", "trait", "enum") and after.kind == "name" and after.text.lower() not in KEYWORDS:
                return self.class_like(None)
            if word == "function" and (after.kind == "name" or after.text == "&" and self.peek(2).kind == "name"):
                return self.function("function")
            if word == "const" and after.kind == "name":
                return self.constants("const")
            if word == "define" and after.text == "(" and self.peek(2).kind == "string":
                name = self.peek(2).text[1:-1]
                self.row("symbol", "define", name, self.peek(2), fqn="\\" + name.lstrip("\\"), value=self.source_until(self.i + 4), **self.documented(self.take_doc()))
            if word == "global":
                self.i += 1
                doc = self.take_doc()
                while self.peek().kind == "var":
                    v = self.next()
                    types = self.type_list(doc.types("global") if doc else None)
                    self.row("symbol", "global", v.text, v, fqn=v.text, types=types)
                    self.mark(v, "declare")
                    self.version(v.text, self.node("global", v.text, v, types=types)[SEQ], None)
                    self.take(",")
                return
        self.expression_token()

    def source_until(self, i: int) -> str:
        depth, start = 0, i
        while i < len(self.t) and not (depth == 0 and self.t[i].text in (",", ";", ")") and self.t[i].kind == "op"):
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(self.t[i].text, 0) if self.t[i].kind == "op" else 0
            i += 1
        return self.text[self.t[start].start : self.t[i - 1].end] if i > start and start < len(self.t) else ""

    def use(self) -> None:
        first = self.next()
        kind = self.next().text.lower() if self.peek().text.lower() in ("function", "const") else "class"
        prefix = ""
        while self.peek().kind in ("name", "op") and self.peek().text != ";":
            if self.take("{"):
                continue
            if self.take("}", ","):
                continue
            own = self.next().text.lower() if self.peek().text.lower() in ("function", "const") and self.peek(1).kind == "name" else kind
            name = self.next()
            if name.kind != "name":
                continue
            if name.text.endswith("\\") and self.peek().text == "{":
                prefix = name.text
                continue
            full = "\\" + (prefix + name.text).strip("\\")
            alias = full.rsplit("\\", 1)[1]
            last = name
            if self.take("as"):
                last = self.next()
                alias = last.text
            self.imports[own][alias if own == "const" else alias.lower()] = full
            self.row("import", own, alias, name, last, fqn=full)
        if self.take(";"):
            self.place = ("use", first, self.peek(-1))

    def names(self) -> Iterator[Token]:
        while self.peek().kind == "name":
            yield self.next()
            if not self.take(",", "|"):
                return

    def class_like(self, modifier: str | None, anonymous: Token | None = None) -> None:
        doc, kind = self.take_doc(), "class" if anonymous else self.next().text.lower()
        before = self.owner, self.parent
        if anonymous:
            name, token = self.anonymous(*self.position(anonymous.start)), anonymous
        else:
            token = self.next()
            name = token.text
        fqn = self.fqn(name)
        self.owner, self.parent = "", ""
        row = self.row("symbol", "class" if kind == "enum" else kind, name, token, fqn=fqn, owner="", modifier=modifier, visibility=0, **self.documented(doc))
        if kind != "trait":
            self.row("reference", "class", name, token, fqn=fqn)
        self.owner = fqn
        if self.take(":"):
            self.next()
        for word in ("extends", "implements"):
            if self.take(word):
                for ord_, n in enumerate(self.names()):
                    to = self.class_name(n.text)
                    self.parent = to if word == "extends" and kind == "class" else self.parent
                    self.row("edge", "extends" if word == "extends" else "implements", str(ord_), n, fqn=fqn, value=to)
                    self.node("interface" if word == "implements" or kind == "interface" else "class", n.text, n, types=to)
                    self.reference("class", to, n)
        for t, v in doc.tags if doc else ():
            if t == "method" and (m := re.match(r"(static\s+)?(?:(\S+)\s+)?(\w+)\s*\(", v)):
                self.row("symbol", "method", m[3], token, fqn=m[3], types=self.type_list(m[2]), visibility=0, is_static=bool(m[1]))
            elif t.startswith("property") and (m := re.match(r"(\S+)\s+(\$\w+)", v)):
                self.row("symbol", "property", m[2], token, fqn=m[2], types=self.type_list(m[1]), visibility=0, is_static=False)
        if self.take("{"):
            self.members()
        row[END_LINE], row[END_CHAR] = self.position(self.peek(-1).end)
        self.owner, self.parent = before

    def anonymous(self, line: int, char: int) -> str:
        return f"anonClass#{hashlib.md5(self.uri.encode()).hexdigest()[:6]}#{line}:{char}"

    def members(self) -> None:
        visibility, static, modifier, declared, start = 0, False, None, None, None
        while (token := self.peek()).kind != "end":
            word = token.text.lower()
            if token.kind == "op" and word == "}":
                self.i += 1
                return
            if token.kind == "doc":
                self.doc = Doc(self.next().text)
                continue
            if token.kind == "op" and word == "#[":
                self.attribute()
                continue
            start = start or token
            if token.kind == "name" and word in ("public", "protected", "private"):
                visibility = ("public", "protected", "private").index(word)
                self.i += 1
            elif token.kind == "name" and word in ("static", "var", "abstract", "final", "readonly"):
                static, modifier = static or word == "static", word if word in ("abstract", "final") else modifier
                self.i += 1
            elif token.kind == "name" and word == "use":
                self.i += 1
                for ord_, n in enumerate(self.names()):
                    to = self.class_name(n.text)
                    self.row("edge", "use", str(ord_), n, fqn=self.owner, value=to)
                    self.node("trait", n.text, n, types=to)
                    self.reference("class", to, n)
                if self.take("{"):
                    self.skip("}")
                start = None
            elif token.kind == "name" and word == "const":
                self.constants("class_const", visibility)
                visibility, static, modifier, declared, start = 0, False, None, None, None
            elif token.kind == "name" and word == "case":
                self.i += 1
                n = self.next()
                self.row("symbol", "class_const", n.text, n, fqn=n.text, visibility=0, value=self.source_until(self.i + 1) if self.peek().text == "=" else "")
                start = None
            elif token.kind == "name" and word == "function":
                self.function("method", visibility, static, modifier)
                visibility, static, modifier, declared, start = 0, False, None, None, None
            elif token.kind == "var":
                doc = self.take_doc()
                while self.peek().kind == "var":
                    v = self.next()
                    types = self.type_list(doc.types("var") if doc else None) or declared
                    self.row("symbol", "property", v.text, v, fqn=v.text, types=types, visibility=visibility, is_static=static, value=self.source_until(self.i + 1) if self.peek().text == "=" else None, **self.documented(doc))
                    self.row("reference", "property", v.text, v, fqn="." + v.text)
                    while self.peek().kind != "end" and self.peek().text not in (",", ";"):
                        self.expression_token()
                    self.take(",")
                self.take(";")
                self.state()
                visibility, static, modifier, declared, start = 0, False, None, None, None
            elif token.kind == "name" or word in ("?", "|", "&", "(", ")"):
                declared = (declared or "") if word in ("?", "|", "&", "(", ")") else "|".join(filter(None, [declared, self.class_name(token.text)]))
                self.i += 1
            else:
                self.i += 1
                start = None
        self.row("error", "syntax", "}", self.peek())

    def attribute(self) -> None:
        depth = 0
        while self.peek().kind != "end":
            t = self.next()
            depth += {"#[": 1, "[": 1, "]": -1}.get(t.text, 0) if t.kind == "op" else 0
            if not depth:
                return

    def skip(self, close: str) -> None:
        depth = 1
        while depth and self.peek().kind != "end":
            t = self.next()
            depth += {"{": 1, "}": -1}.get(t.text, 0) if t.kind == "op" else 0

    def constants(self, kind: str, visibility: int = 0) -> None:
        self.i += 1
        doc = self.take_doc()
        if self.peek().kind == "name" and self.peek(1).kind == "name":
            self.i += 1  # a declared type
        while self.peek().kind == "name":
            n = self.next()
            value = self.source_until(self.i + 1) if self.peek().text == "=" else ""
            fqn = n.text if kind == "class_const" else self.fqn(n.text)
            self.row("symbol", kind, n.text, n, fqn=fqn, visibility=visibility, value=value, **self.documented(doc))
            self.row("reference", kind, n.text, n, fqn="." + n.text if kind == "class_const" else fqn)
            while self.peek().kind != "end" and self.peek().text not in (",", ";"):
                self.expression_token()
            self.take(",")
        self.take(";")
        self.state()

    def parameters(self, doc: Doc | None) -> list[str]:
        shown = []
        if not self.take("("):
            return shown
        types, depth = None, 0
        notes = {m[2]: m[1] for t, v in (doc.tags if doc else ()) if t == "param" and (m := re.match(r"(\S+)\s+&?(?:\.\.\.)?(\$\w+)", v))}
        while self.peek().kind != "end" and not (self.peek().text == ")" and not depth):
            t = self.peek()
            if t.kind == "var" and not depth:
                self.i += 1
                own = "|".join(filter(None, [self.type_list(notes.get(t.text)), types]))
                self.mark(t, "parameter", own or None)
                self.version(t.text, self.node("parameter", t.text, t, types=own or None, modifier=str(self.scope))[SEQ], None)
                default = self.source_until(self.i + 1) if self.peek().text == "=" else None
                shown.append(" ".join(filter(None, [own, t.text])) + (f" = {default}" if default else ""))
                while self.peek().kind != "end" and self.peek().text not in (",", ")"):
                    self.expression_token()
                self.take(",")
                types = None
            elif t.kind == "name" and t.text.lower() not in ("public", "protected", "private", "readonly"):
                self.i += 1
                name = self.class_name(t.text)
                types = "|".join(filter(None, [types, name]))
                self.type_node(t, name)
                self.reference("class", name, t)
            elif t.text == "#[":
                self.attribute()
            else:
                self.i += 1
        if not self.take(")"):
            self.row("error", "syntax", ")", self.peek())
        self.state()
        return shown

    def function(self, kind: str, visibility: int = 0, static: bool = False, modifier: str | None = None) -> None:
        doc = self.take_doc()
        self.i += 1
        self.take("&")
        n = self.next()
        fqn = n.text if kind == "method" else self.fqn(n.text)
        self.row("reference", kind, n.text, n, fqn=f".{n.text}()" if kind == "method" else fqn + "()")
        row = self.row("symbol", kind, n.text, n, fqn=fqn, visibility=visibility, is_static=static, modifier=modifier, types=self.type_list(doc.types("return") if doc else None, True), **self.documented(doc))
        outer, self.scope, state = self.scope, len(self.rows), self.state()
        region = self.row("scope", kind, n.text, n, value=str(self.scope), fqn=str(outer))
        row[VALUE] = ", ".join(self.parameters(doc))
        declared = self.return_type()
        row[TYPES] = row[TYPES] or declared
        self.body()
        row[END_LINE], row[END_CHAR] = region[END_LINE], region[END_CHAR] = self.position(self.peek(-1).end)
        self.scope = outer
        self.restore(state)

    def return_type(self) -> str | None:
        found = []
        if self.take(":"):
            while self.peek().kind == "name" or self.peek().text in ("?", "|", "&", "(", ")"):
                t = self.next()
                if t.kind == "name":
                    name = self.class_name(t.text)
                    found.append(t.text.lower() if t.text.lower() == "static" else name)
                    self.type_node(t, name)
                    self.reference("class", name, t)
        return "|".join(dict.fromkeys(found)) or None

    def body(self) -> None:
        if self.take("{"):
            self.statements("}")
        else:
            self.take(";")

    def reference(self, kind: str, name: str, token: Token) -> None:
        if name.lower() not in NATIVES and token.text.lower() not in MAGIC:
            self.row("reference", kind, token.text, token, fqn=name)

    def mark(self, token: Token, kind: str, types: str | None = None) -> None:
        self.row("variable", kind, token.text, token, value=str(self.scope), types=types)

    # expressions: nodes, their links, argument lists
    def node(self, kind: str, name: str, token: Token, scope: int | None = None, types: str | None = None, **more) -> list:
        return self.row("expr", kind, name, token, value=None if scope is None else str(scope), types=types or None, **more)

    def type_node(self, token: Token, name: str) -> None:
        if name.lower() not in NATIVES:
            self.node("type", token.text, token, types=name)

    def version(self, name: str, node: int | None, types: str | None) -> None:
        """A variable's types are from here on those of a node and those stated."""
        self.versions.setdefault(self.scope, {})[name] = (node, types)

    def state(self) -> tuple:
        """What is open in the expression around a body; the body starts anew."""
        held = self.last, self.open, self.due, self.loose
        self.last, self.open, self.due, self.loose = None, [], [], False
        return held

    def restore(self, held: tuple) -> None:
        self.last, self.open, self.due, self.loose = held
        self.last = None

    def settle(self) -> None:
        """Ends the assignments of this bracket: their targets have the types of the node just read, if it is all there is."""
        while self.due and self.due[-1][0] == len(self.open):
            _, target, node = self.due.pop()
            source = None if self.loose else self.last
            if target[0] == "variable":
                self.version(target[1], source, target[2])
                if source is not None:
                    self.rows[node][VALUE] = str(source)
            elif source is not None:  # a property of this class
                self.row("link", "property", target[1], Token("op", "", 0, 0), value=str(source))

    def bracket(self, token: Token, before: Token) -> None:
        if token.text in ("(", "["):
            called = token.text == "(" and self.last is not None and (before.kind in ("name", "var") or before.text in (")", "]", "}")) and self.rows[self.last][KIND] in CALLS
            header = before.text.lower() if token.text == "(" and before.kind == "name" and not called else ""
            row = self.row("arguments", self.rows[self.last][KIND], "", token, value=str(self.last)) if called else None
            self.open.append({"by": token.text, "call": self.last if called else None, "row": row, "header": header, "from": self.i, "n": 0, "loose": self.loose, "of": self.last})
            self.last, self.loose = None, False
            return
        self.settle()
        if not self.open:
            return
        frame = self.open.pop()
        self.argument(frame)
        if frame["row"] is not None:
            frame["row"][END_LINE], frame["row"][END_CHAR] = self.position(token.end)
        inner = None if self.loose or frame["n"] > 1 else self.last
        self.loose = frame["loose"]
        self.last = frame["call"] if frame["call"] is not None else inner if frame["by"] == "(" and not frame["header"] else None

    def argument(self, frame: dict) -> None:
        """The argument that ends before the token just read."""
        a, b = frame["from"], self.i - 2
        if frame["row"] is not None and b >= a:
            self.row("argument", frame["row"][KIND], str(frame["n"]), self.t[a], self.t[b], value=str(frame["row"][SEQ]))
        frame["n"] += b >= a
        frame["from"] = self.i

    def operator(self, token: Token, before: Token) -> None:
        text = token.text
        if text in ("(", "[", ")", "]"):
            self.bracket(token, before)
        elif text == ",":
            self.settle()
            if self.open:
                self.argument(self.open[-1])
            self.last, self.loose = None, False
        elif text == ";":
            self.settle()
            self.last, self.loose, self.open, self.due = None, False, [], []
        elif text == "=" and self.last is not None and self.rows[self.last][KIND] == "property" and self.rows[self.last][MODIFIER] == "this":
            self.due.append((len(self.open), ("property", self.rows[self.last][NAME]), self.last))
            self.last, self.loose = None, False
        elif text in ("=", "=>"):
            self.last, self.loose = None, False
        elif text not in ("->", "?->", "::", "&", "@"):
            self.last, self.loose = None, True

    def access(self, kind: str, token: Token) -> int:
        """A node for a member of the node just read; modifier says how the scope is named."""
        scope_kind, name = self.rows[self.last][KIND : NAME + 1] if self.last is not None else ("", "")
        low = name.lower()
        how = "this" if scope_kind == "this" else "parent" if low in PARENT else "relative" if low in RELATIVE and scope_kind == "class" else "name"
        return self.node(kind, token.text, token, self.last, modifier=how)[SEQ]

    def variable(self, token: Token, types: str | None = None) -> int:
        """A node for a use of a variable: its types are those of its last version in the scope."""
        source, stated = self.versions.get(self.scope, {}).get(token.text, (None, None))
        types = "|".join(dict.fromkeys(filter(None, [stated, types]))) or None
        if token.text == "$this":
            return self.node("this", token.text, token, types=self.owner or None)[SEQ]
        return self.node("variable", token.text, token, source, types, modifier=None if self.scope else "global")[SEQ]

    def assigned(self, token: Token, before: Token) -> None:
        """A node for a variable that gets a value: by =, in a loop, in a catch."""
        header = self.open[-1] if self.open else {"header": ""}
        doc = self.doc if self.peek().text == "=" else None
        stated = self.type_list(doc.types("var") if doc else None)
        node = self.node("variable", token.text, token, types=stated)
        if self.peek().text == "=":
            self.next()  # no earlier value is read
            self.take("&")
            self.due.append((len(self.open), ("variable", token.text, stated), node[SEQ]))
            self.last, self.loose = None, False
            return
        if "collection" in header and before.text.lower() != "as" or self.peek().text == ")":
            element = self.node("element", token.text, token, header.get("collection"))[SEQ]
            node[VALUE] = str(element)
            self.version(token.text, element, None)
        else:
            self.version(token.text, None, None)
        self.last = None

    def expression_token(self) -> None:
        t, n = self.t, self.n
        token = t[self.i] if self.i < n else self.end
        self.i = i = self.i + 1
        after = t[i] if i < n else self.end
        before = t[i - 2] if i > 1 else Token("end", "", 0, 0)
        if token.kind == "op":
            if token.text == "{":
                state = self.state()
                self.statements("}")
                self.restore(state)
            elif token.text != "#[":
                self.operator(token, before)
            if token.text == "{":
                pass
            elif token.text == "#[":
                self.i -= 1
                self.attribute()
            elif token.text != "&":
                self.doc = None
            return
        word = token.text.lower()
        if token.kind not in ("var", "name"):
            self.last = None
        if token.kind == "var":
            if before.text == "::":
                self.last = self.access("static_property", token)
                self.row("access", "static_property", token.text, token, fqn="." + token.text)
                self.row("reference", "property", token.text, token, fqn="." + token.text)
            elif after.text == "=" or before.text.lower() in ("as", "=>") and after.text in (")", "=>"):
                new = self.peek(1).text.lower() == "new" and self.peek(2).kind == "name" and self.peek(2).text.lower() != "class"
                self.mark(token, "declare", self.class_name(self.peek(2).text) if new else None)
                self.assigned(token, before)
            elif self.open and self.open[-1]["header"] == "catch" and after.text == ")":
                types = "|".join(r[TYPES] for r in self.rows[self.open[-1]["first"] :] if r[TAG] == "expr" and r[KIND] in ("class", "type") and r[TYPES]) if "first" in self.open[-1] else None
                self.mark(token, "use")
                self.version(token.text, self.node("variable", token.text, token, types=types)[SEQ], None)
            else:
                if token.text != "$this":
                    self.mark(token, "use")
                self.last = self.variable(token)
            return
        if token.kind != "name":
            return
        if before.text in ("->", "?->"):
            method = after.text == "("
            self.last = self.access("method" if method else "property", token)
            self.row("access", "method" if method else "property", token.text, token, fqn=f".{token.text}()" if method else f".${token.text}")
            self.row("reference", "method" if method else "property", token.text, token, fqn=f".{token.text}()" if method else f".${token.text}")
        elif before.text == "::":
            if word == "class":
                self.last = None
                return
            method = after.text == "("
            self.last = self.access("static_method" if method else "class_const", token)
            self.row("access", "static_method" if method else "class_const", token.text, token, fqn=f".{token.text}()" if method else f".{token.text}")
            self.row("reference", "method" if method else "class_const", token.text, token, fqn=f".{token.text}()" if method else f".{token.text}")
        elif word in ("function", "fn"):
            outer, self.scope, state = self.scope, len(self.rows), self.state()
            region = self.row("scope", word, "", token, value=str(self.scope), fqn=str(outer))
            if word == "fn":  # sees all around it
                self.versions[self.scope] = dict(self.versions.get(outer, {}))
            self.take("&")
            self.parameters(self.take_doc())
            if self.take("use") and self.take("("):
                while self.peek().kind != "end" and not self.take(")"):
                    v = self.next()
                    if v.kind == "var":
                        inner, self.scope = self.scope, outer
                        self.mark(v, "use")
                        seen = self.variable(v)
                        self.scope = inner
                        self.mark(v, "declare")
                        self.version(v.text, seen, None)
            self.return_type()
            if word == "function":
                self.body()
                self.scope = outer
            else:
                self.scope = outer
            region[END_LINE], region[END_CHAR] = self.position(self.peek(-1).end)
            self.restore(state)
            if word == "fn":  # what it is assigned to has not the types of its body
                self.due = [d for d in self.due if d[0] != len(self.open)]
        elif word == "new" and after.text.lower() == "class":
            at = self.next()
            line, char = self.position(at.start)
            self.last = made = self.node("new", "class", at, types=self.fqn(self.anonymous(line, char)))[SEQ]
            if self.peek().text == "(":
                depth = 0
                while self.peek().kind != "end":
                    depth += {"(": 1, ")": -1}.get(self.peek().text, 0) if self.peek().kind == "op" else 0
                    self.expression_token()
                    if not depth:
                        break
            state = self.state()
            self.class_like(None, at)
            self.restore(state)
            self.last = made
        elif word in KEYWORDS and word not in ("static",):
            if word == "as" and self.open and self.open[-1]["header"] == "foreach":
                self.open[-1]["collection"] = None if self.loose else self.last
            if word not in ("clone", "instanceof", "new", "print", "yield"):
                self.last = None
            return
        elif after.text == "::" or before.text.lower() in ("new", "instanceof") or before.text == "(" and self.t[self.i - 3 if self.i > 2 else 0].text.lower() == "catch" or after.kind == "var":
            name = self.class_name(token.text)
            if before.text == "(" and self.open:
                self.open[-1]["first"] = len(self.rows)
            kind = "new" if before.text.lower() == "new" else "type" if before.text.lower() == "instanceof" else "class"
            held, self.last = self.last, self.node(kind, token.text, token, types=name)[SEQ]
            if kind == "type" and held is not None and self.rows[held][KIND] == "variable":
                tested = self.rows[held]
                tested[TYPES] = "|".join(dict.fromkeys(filter(None, [tested[TYPES], name])))
                self.version(tested[NAME], held, None)
                self.last, self.loose = None, True
            self.row("access", "new" if before.text.lower() == "new" else "class", token.text, token, fqn=name)
            self.reference("class", name, token)
        elif after.text == "(":
            found = self.other_names(token.text, "function")
            self.last = self.node("function", token.text, token, fqn="|".join(found))[SEQ]
            for name in found:
                self.row("access", "function", token.text, token, fqn=name)
                self.row("reference", "function", token.text, token, fqn=name + "()")
        elif word not in NATIVES and word not in ("true", "false", "null"):
            found = self.other_names(token.text, "const")
            self.last = self.node("const", token.text, token, fqn="|".join(found))[SEQ]
            for name in found:
                self.row("access", "const", token.text, token, fqn=name)
                self.row("reference", "const", token.text, token, fqn=name)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in map(str.split, SCHEMA.split(", "))]
    held: list[list] = [[] for _ in fields]  # a list for each column

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, fields, strict=True)], COLUMNS)
        for c in held:
            c.clear()
        return made

    for b in batches:
        for uri, content in zip(b.column("uri"), b.column("content"), strict=True):
            content = content.as_py()
            if content:
                for c, values in zip(held, zip(*Extractor(uri.as_py(), content.decode("utf-8", "replace")).run(), strict=True), strict=True):
                    c.extend(values)
            if len(held[0]) >= HELD:
                yield batch()
    yield batch()


def tasks(spark: SparkSession, files: int) -> int:
    """Into how many tasks so many files of any place are dealt: all cores have some, and none more than a bounded number."""
    return max(-(-files // PER_TASK), min(spark.sparkContext.defaultParallelism, files // 500), 1)


def extract(files: DataFrame) -> DataFrame:
    """All tagged rows of files (uri, content)."""
    return files.select("uri", F.col("content").cast("binary").alias("content")).mapInArrow(_extract, SCHEMA)
