"""Requests at a place of a document: definition, hover, signatures, references, rename and completion.

A request is a plan over the tables of a catalog and its inference, filtered by file first; only the reading of what stands
before the cursor (which completion is wanted) looks at the one text, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import tokens as T
from ..operators import hierarchy as H
from ..operators import search as S
from ..sources import php
from .engine import Catalog
from .inference import KEYS, TARGET, Inference

#: What a static member costs in the list of an instance's members.
STATIC_COST = 1
ITEM = ["kind", "label", "insert_text", "detail", "documentation", "fqn", "edit_line", "edit_character", "edit_text"]


#: Numbers that editors give to kinds of symbols.
SYMBOL_KINDS = {"namespace": 3, "class": 5, "trait": 5, "method": 6, "property": 7, "interface": 11, "function": 12, "global": 13, "const": 14, "class_const": 14, "define": 14}


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """(name, kind number, container, uri, range, deprecated) of symbols, as editors list them."""
    number = F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair])
    container = F.when(F.col("owner") != "", F.col("owner")).otherwise(N.namespace_of(F.col("fqn")))
    start, end = N.position(F.col("start_line"), F.col("start_char")), N.position(F.col("end_line"), F.col("end_char"))
    return symbols.select("name", number[F.col("kind")].alias("kind"), container.alias("container"), "uri", F.struct(start.alias("start"), end.alias("end")).alias("range"), F.col("deprecated").isNotNull().alias("deprecated"))


@dataclass
class Context:
    """What is asked for at a place: the variant of completion, the word typed, the place where the scope's expression ends."""

    variant: str | None
    word: str
    scope_end: int | None = None


def _owner_of_use(tokens: list[php.Token]) -> bool:
    """Whether the last `use` stands in the braces of a class or trait."""
    depth, inside = 0, []
    pending = False
    for t in tokens:
        if t.kind == "name" and t.text.lower() in ("class", "trait", "enum"):
            pending = True
        elif t.text == "{" and t.kind == "op":
            depth += 1
            if pending:
                inside.append(depth)
            pending = False
        elif t.text == "}" and t.kind == "op":
            if inside and inside[-1] == depth:
                inside.pop()
            depth -= 1
    return bool(inside) and inside[-1] == depth


def context(text: str, offset: int) -> Context:
    """The completion that the text before a cursor asks for."""
    before = text[:offset]
    word = re.search(r"[\\a-zA-Z0-9_\x80-\U0010ffff]*\Z", before).group()
    tokens = php.lex(before)
    if not tokens:
        return Context(None, word)
    current = tokens[-1] if tokens[-1].end == offset and (tokens[-1].kind in ("name", "var") or tokens[-1].text == "$") else None
    rest = tokens[:-1] if current else tokens
    if not rest:
        return Context("name" if current and current.kind == "name" else "variable" if current else None, current.text if current and current.kind != "name" else word)
    last, low = rest[-1], rest[-1].text.lower()
    if last.text in ("->", "?->"):
        return Context("member", word, last.start)
    if last.text == "::":
        return Context("static_property" if current and current.kind != "name" else "scoped", ("$" if current and current.kind != "name" else "") + word, last.start)
    if current and current.kind != "name":
        return Context("variable", current.text)
    at = len(rest) - 1  # back over the names of a list
    while at > 0 and rest[at].text == "," and rest[at - 1].kind == "name":
        at -= 2
    head = rest[at].text.lower() if rest[at].kind == "name" else ""
    if last.kind == "name" and low == "new":
        return Context("class", word)
    if head == "extends":
        kind = next((t.text.lower() for t in reversed(rest[:at]) if t.kind == "name" and t.text.lower() in ("class", "interface")), "class")
        return Context(kind, word)
    if head == "implements":
        return Context("interface", word)
    if head == "use" and _owner_of_use(rest):
        return Context("trait", word)
    if last.kind == "name" and low == "instanceof" or len(rest) > 1 and last.text in ("(", "|") and any(t.text.lower() == "catch" for t in rest[-4:]):
        return Context("type", word)
    if last.text == ":" and len(rest) > 1 and rest[-2].text == ")":
        return Context("type", word)
    if last.text in ("(", ",") and current:
        depth = 0
        for i in range(len(rest) - 1, -1, -1):
            depth += {")": 1, "(": -1}.get(rest[i].text, 0) if rest[i].kind == "op" else 0
            if depth < 0:
                if i and (rest[i - 1].text.lower() in ("function", "fn") or i > 1 and rest[i - 2].text.lower() == "function"):
                    return Context("type", word)
                break
    return Context("name" if current else None, word)


class Cursor:
    """Requests at places of the documents of a catalog."""

    def __init__(self, catalog: Catalog, inference: Inference | None = None):
        self.catalog, self.inference = catalog, inference or Inference(catalog)

    # what stands at a place
    @staticmethod
    def holds(line: int, character: int) -> Column:
        """A range of rows holds a place, its end included."""
        at = N.position(F.lit(line), F.lit(character))
        return (N.position(F.col("start_line"), F.col("start_char")) <= at) & (at <= N.position(F.col("end_line"), F.col("end_char")))

    def node_at(self, uri: str, line: int, character: int) -> DataFrame:
        """The last node whose token holds the place."""
        return self.inference.nodes.where((F.col("uri") == uri) & self.holds(line, character)).orderBy(F.col("node").desc()).limit(1)

    def node_before(self, uri: str, line: int, character: int) -> DataFrame:
        """The last node that starts before the place."""
        start = N.position(F.col("start_line"), F.col("start_char"))
        rows = self.inference.nodes.where((F.col("uri") == uri) & (start < N.position(F.lit(line), F.lit(character))))
        return rows.orderBy(F.col("start_line").desc(), F.col("start_char").desc(), F.col("node").desc()).limit(1)

    def scope_at(self, uri: str, line: int, character: int) -> DataFrame:
        """The innermost function, closure or file that the place stands in: value names it, fqn the one around it."""
        rows = self.catalog.rows.where((F.col("tag") == "scope") & (F.col("uri") == uri) & self.holds(line, character))
        return rows.orderBy(F.col("start_line").desc(), F.col("start_char").desc(), F.col("seq").desc()).limit(1).select("uri", F.col("value").alias("scope"), F.col("fqn").alias("around"), "kind", "name")

    def class_at(self, uri: str, line: int, character: int) -> DataFrame:
        """The first class, interface or trait of the file that does not end before the place."""
        rows = self.catalog.symbols.where((F.col("uri") == uri) & F.col("kind").isin("class", "interface", "trait"))
        return rows.where(N.position(F.col("end_line"), F.col("end_char")) > N.position(F.lit(line), F.lit(character))).orderBy("seq").limit(1)

    def spine(self, uri: str, line: int, character: int) -> DataFrame:
        """All rows with a region that hold the place, outermost first: scopes, declarations, argument lists, the node."""
        rows = self.catalog.rows.where((F.col("uri") == uri) & F.col("tag").isin("scope", "symbol", "arguments", "argument", "expr") & self.holds(line, character))
        return rows.select("tag", "kind", "name", "seq", "start_line", "start_char", "end_line", "end_char").orderBy("start_line", "start_char", F.col("end_line").desc(), F.col("end_char").desc(), "seq")

    def traverse(self, uri: str) -> DataFrame:
        """The declarations of a file in order, each with the number of those it stands in."""
        s = self.catalog.symbols.where(F.col("uri") == uri).select("kind", "name", "owner", "seq", N.position(F.col("start_line"), F.col("start_char")).alias("a"), N.position(F.col("end_line"), F.col("end_char")).alias("b"))
        regions = F.sort_array(F.collect_list(F.struct("a", "b", "seq")))
        all_ = s.agg(regions.alias("all"))  # one file's declarations
        depth = F.size(F.filter("all", lambda o: (o["a"] <= F.col("a")) & (F.col("b") <= o["b"]) & (o["seq"] != F.col("seq"))))
        return s.withColumn("uri", F.lit(uri)).join(all_.withColumn("uri", F.lit(uri)), "uri").select("seq", "kind", "name", "owner", depth.alias("depth")).orderBy("seq")

    # definition, hover
    def definition(self, uri: str, line: int, character: int) -> DataFrame:
        """Places of the declarations that the access at a place means, in order."""
        found = self.node_at(uri, line, character).select(*KEYS).join(self.inference.definitions, KEYS)
        return found.orderBy("ord", "target_uri", "target_line").select("fqn", "member", *TARGET)

    def deprecated(self) -> DataFrame:
        """One row per access that some deprecated declaration answers: members by the types of their scope, names by themselves."""
        nodes = self.inference.nodes.select(*KEYS, F.col("start_line").alias("line"), F.col("start_char").alias("character"))
        hits = self.inference.definitions.where("deprecated is not null").select(*KEYS, "ord", "fqn", "member", "deprecated")
        return H.first_wins(nodes.join(hits, KEYS), ["uri", "line", "character"], ["ord", "fqn", "member"]).select("uri", "line", "character", "fqn", "member", "deprecated")

    def hover(self, uri: str, line: int, character: int) -> DataFrame:
        """Markdown for what stands at a place: a variable with its types, or the declarations that it means."""
        node = self.node_at(uri, line, character)
        shown = node.select(*KEYS).join(self.inference.definitions.select(*KEYS, "ord", "symbol_key"), KEYS).join(self.catalog.symbols.drop("uri"), "symbol_key").select("ord", hover_text().alias("markdown"))
        types = self.inference.types.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list(F.concat("fqn", F.repeat(F.lit("[]"), F.col("level").cast("int"))))), "|").alias("t"))
        variables = node.where("kind in ('variable', 'parameter', 'this', 'global', 'element')").join(types, KEYS, "left")
        text = F.concat(F.lit("```php\n"), F.concat_ws(" ", "t", "name"), F.lit("\n```"))
        return shown.unionByName(variables.select(F.array(F.lit(0).cast("int")).alias("ord"), text.alias("markdown"))).orderBy("ord", "markdown").select("markdown")

    # signatures
    def _arguments(self) -> DataFrame:
        rows = self.catalog.rows.where("tag = 'arguments'")
        return rows.select("uri", F.col("seq").alias("list"), F.col("value").cast("long").alias("node"), "start_line", "start_char", "end_line", "end_char")

    def _argument_ranges(self) -> DataFrame:
        rows = self.catalog.rows.where("tag = 'argument'")
        return rows.select("uri", F.col("value").cast("long").alias("list"), F.col("name").cast("int").alias("i"), "start_line", "start_char", "end_line", "end_char")

    def arguments_at(self, uri: str, line: int, character: int) -> DataFrame:
        """The innermost argument list around a place, its callee's node and the number of the argument there."""
        at = N.position(F.lit(line), F.lit(character))
        inside = (N.position(F.col("start_line"), F.col("start_char")) < at) & (at < N.position(F.col("end_line"), F.col("end_char")))
        best = self._arguments().where((F.col("uri") == uri) & inside).orderBy(F.col("start_line").desc(), F.col("start_char").desc()).limit(1).select("uri", "list", "node")
        ended = self._argument_ranges().where((F.col("uri") == uri) & (N.position(F.col("end_line"), F.col("end_char")) < at)).groupBy("uri", "list").agg(F.count("*").alias("active"))
        return best.join(ended, ["uri", "list"], "left").withColumn("active", F.coalesce("active", F.lit(0)))

    def parameters(self) -> DataFrame:
        """(uri, line, character of a function's name, i, name) of every parameter."""
        p = self.catalog.rows.where("tag = 'expr' and kind = 'parameter'").select("uri", F.col("modifier").alias("scope"), "seq", "name")
        s = self.catalog.rows.where("tag = 'scope'").select("uri", F.col("value").alias("scope"), F.col("start_line").alias("target_line"), F.col("start_char").alias("target_character"))
        listed = p.join(s, ["uri", "scope"]).groupBy("uri", "target_line", "target_character").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("ps"))
        return listed.select(F.col("uri").alias("target_uri"), "target_line", "target_character", F.posexplode("ps.name").alias("i", "parameter"))

    def signature_help(self, uri: str, line: int, character: int, trigger: str = "") -> DataFrame:
        """Signatures of what is called around a place, and the number of the parameter there; none after a closing bracket."""
        at = self.arguments_at(uri, line, character).limit(0 if trigger == ")" else 1)
        rows = at.join(self.inference.callables, KEYS)
        label = F.concat("member", F.lit("("), F.coalesce("member_value", F.lit("")), F.lit(")"))
        return rows.orderBy("ord", "symbol_key").select(label.alias("label"), "description", "active")

    def document_signatures(self, uri: str) -> DataFrame:
        """(line, character, i, parameter): the names of the parameters that each argument of the file fills, by the first callee."""
        calls = self._arguments().where(F.col("uri") == uri).select("uri", "node", "list")
        first = H.first_wins(calls.join(self.inference.callables, KEYS).select("uri", "list", "ord", "symbol_key", *TARGET), ["uri", "list"], ["ord", "symbol_key"])
        filled = first.join(self.parameters(), ["target_uri", "target_line", "target_character"])
        ranges = self._argument_ranges().where(F.col("uri") == uri)
        return filled.select("uri", "list", "i", "parameter").join(ranges, ["uri", "list", "i"]).select(F.col("start_line").alias("line"), F.col("start_char").alias("character"), "i", "parameter")

    # references, rename
    def references(self, uri: str, line: int, character: int) -> DataFrame:
        """All places of the names that the name at a place may be."""
        rows = self.catalog.references
        asked = rows.where((F.col("uri") == uri) & self.holds(line, character)).select("ref").distinct()
        return rows.join(F.broadcast(asked.limit(16)), "ref", "left_semi")  # one token is at most a function's two names

    def rename(self, uri: str, line: int, character: int, new_name: str) -> DataFrame:
        """Edits that give the variable at a place another name, in its scope; nothing for other symbols."""
        rows = self.catalog.variables.where(F.col("uri") == uri)
        asked = rows.where(self.holds(line, character)).select("uri", "value", "name").distinct()
        return rows.join(asked, ["uri", "value", "name"], "left_semi").select("uri", "start_line", "start_char", "end_line", "end_char", F.lit(new_name).alias("new_text")).distinct()

    # names and imports at a place
    def imports_at(self, uri: str, line: int, character: int) -> DataFrame:
        """One row: the namespace in force (the last before the place, else the first) and the imports made in it."""
        spaces = self.catalog.rows.where((F.col("tag") == "namespace") & (F.col("uri") == uri)).select("uri", N.position(F.col("start_line"), F.col("start_char")).alias("at"), "fqn")
        before = F.col("at") < N.position(F.lit(line), F.lit(character))
        space = spaces.groupBy("uri").agg(F.coalesce(F.max_by("fqn", F.when(before, F.col("at"))), F.min_by("fqn", "at")).alias("space"))
        files = self.catalog.rows.where((F.col("tag") == "scope") & (F.col("kind") == "file") & (F.col("uri") == uri)).select("uri")
        at = files.join(space, "uri", "left").withColumn("space", F.coalesce("space", F.lit("\\")))
        made = self.catalog.imports.where(F.col("uri") == uri).select("uri", F.col("namespace").alias("space"), F.struct("kind", "name", "fqn").alias("i"))
        return at.join(made, ["uri", "space"], "left").groupBy("uri", "space").agg(F.sort_array(F.collect_list("i")).alias("imports"))

    def labelled(self, found: DataFrame, uri: str, line: int, character: int, word: str) -> DataFrame:
        """Symbols with the shortest label that is valid at a place, and the import to insert where none is."""
        at = self.imports_at(uri, line, character)
        insert = self.catalog.rows.where((F.col("tag") == "insert") & (F.col("uri") == uri)).select(
            "uri", F.col("kind").alias("after"), F.col("end_line").alias("line"), F.col("end_char").alias("character"), F.col("value").alias("indent"), F.col("description").alias("eol")
        )
        rows = found.drop("uri").withColumn("uri", F.lit(uri)).join(at, "uri").join(insert, "uri", "left")
        own, short = N.namespace_of(F.col("fqn")), F.col("name")
        typed = N.namespace_of(N.qualify(F.lit(word), F.col("space")))
        scope = N.scope_of(F.lit(word)) if "\\" in word else F.lit("")
        parts = N.parts(F.col("fqn"))
        head = F.get(F.filter("imports", lambda i: (i["kind"] == "class") & (i["name"] == F.get(parts, F.lit(0))) & F.lit(word).startswith(F.substring(i["fqn"], F.lit(2), F.length(i["fqn"])))), F.lit(0))
        alias = F.get(F.filter("imports", lambda i: (i["kind"] == "class") & (i["fqn"] == F.col("fqn"))), F.lit(0))["name"]
        of_head = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\\")).otherwise(F.get(parts, F.lit(0)))
        loose = F.col("kind").isin("function", "const", "define") & (own == "\\")
        absolute = word.startswith("\\") or word in N.NATIVES
        needs = F.lit(not absolute) & (typed != own) & head.isNull() & ~loose & alias.isNull()
        label = F.when(F.lit(absolute) | (typed == own), short).when(head.isNotNull(), of_head).when(loose, short).otherwise(F.coalesce(alias, short))
        what = F.when(F.lit("\\" in word) & (scope == own), own).otherwise(F.col("fqn"))
        kind = F.when(what == own, F.lit("")).when(F.col("kind") == "function", F.lit("function ")).when(F.col("kind").isin("const", "define"), F.lit("const ")).otherwise(F.lit(""))
        text = F.concat("eol", F.when(F.col("after") == "namespace", F.col("eol")).otherwise(F.lit("")), "indent", F.lit("use "), kind, F.substring(what, F.lit(2), F.length(what)), F.lit(";"))
        edit = lambda c: F.when(needs, c)
        return rows.withColumns({"label": label, "edit_line": edit(F.col("line")), "edit_character": edit(F.col("character")), "edit_text": edit(text)}).drop("space", "imports", "after", "line", "character", "indent", "eol")

    # completion
    def _items(self, rows: DataFrame, insert: Column | None = None) -> DataFrame:
        detail = F.when(F.col("edit_text").isNotNull(), F.trim(F.regexp_replace("edit_text", r"[\r\n]+", ""))).otherwise(F.col("fqn"))
        return rows.select("kind", "label", (F.col("label") if insert is None else insert).alias("insert_text"), detail.alias("detail"), F.col("description").alias("documentation"), "fqn", "edit_line", "edit_character", "edit_text")

    def names(self, kinds: list[str], uri: str, line: int, character: int, word: str, limit: int = S.LIMIT) -> DataFrame:
        """Symbols of some kinds that a word finds, with labels; namespaces too where the word begins with a backslash."""
        found = None
        for kind in kinds:
            rows = self.labelled(self.catalog.search(kind, word, limit), uri, line, character, word)
            call = F.when(F.col("kind") == "function", F.concat("label", F.when(F.coalesce("value", F.lit("")) == "", "()").otherwise("($0)"))).otherwise(F.col("label"))
            items = self._items(rows, call)
            found = items if found is None else found.unionByName(items)
        if word.startswith("\\") and len(kinds) > 1:
            scope, _, short = word.rpartition("\\")
            spaces = self.catalog.namespaces().where((F.col("scope") == scope) & F.col("token").startswith(short.lower())).select("ns").distinct()
            none = F.lit(None)
            more = spaces.select(F.lit("namespace").alias("kind"), F.col("ns").alias("label"), N.insert_text(F.col("ns"), F.lit(word)).alias("insert_text"), F.col("ns").alias("detail"), none.cast("string").alias("documentation"), F.col("ns").alias("fqn"))
            found = found.unionByName(more.withColumns({"edit_line": none.cast("int"), "edit_character": none.cast("int"), "edit_text": none.cast("string")}))
        return found

    def variables(self, uri: str, line: int, character: int, word: str) -> DataFrame:
        """Variables of the scope at a place that are set before it and hold the word; not the one being typed."""
        scope = self.scope_at(uri, line, character)
        start = N.position(F.col("start_line"), F.col("start_char"))
        rows = self.catalog.variables.where((F.col("uri") == uri) & (start < N.position(F.lit(line), F.lit(character))) & ~self.holds(line, character))
        seen = rows.withColumnRenamed("value", "scope").join(scope.select("uri", "scope"), ["uri", "scope"]).where((F.col("name") != "$") & F.contains("name", F.lit("" if word == "$" else word)))
        types = self.inference.types.join(self.inference.nodes.select(*KEYS, "start_line", "start_char"), KEYS)
        last = seen.groupBy("name").agg(F.max_by(F.struct("uri", "start_line", "start_char"), "seq").alias("p")).select("name", "p.*")
        text = F.array_join(F.sort_array(F.collect_set(F.concat("fqn", F.repeat(F.lit("[]"), F.col("level").cast("int"))))), "|")
        return last.join(types, ["uri", "start_line", "start_char"], "left").groupBy("name").agg(text.alias("detail")).select(F.lit("variable").alias("kind"), F.col("name").alias("label"), "detail")

    def members_of(self, scope: DataFrame, word: str, kinds: tuple[str, ...], static: bool) -> DataFrame:
        """Members that the access rules show of the types of a node (uri, node, inside, how), closest match first by kind and order."""
        typed = scope.join(self.inference.types, KEYS).withColumn("kind", F.lit("static_method" if static else "method"))
        rows = self.inference.classes_of(typed).drop("class_kind").join(self.inference.members, "seed").where(F.col("member_kind").isin(*kinds) & self.inference.allowed(F.col("kind")))
        rows = H.first_wins(rows.select("seed", "member_kind", "member", "owner", "member_types", "member_value", "description", "is_static", "place"), ["seed", "member_kind", "member"], ["place"])
        rows = H.first_wins(rows, ["member_kind", "owner", "member"], ["seed"])
        bare = F.regexp_replace("member", r"^\$", "") if not static else F.col("member")
        rows = fuzzy(rows.withColumn("label", bare), "label", word)
        score = F.col("score") - F.when(F.col("is_static") & F.lit(not static), STATIC_COST).otherwise(0)
        order = F.when(F.col("member_kind") == "method", 0).when(F.col("member_kind") == "property", 1).otherwise(2)
        text = F.when(F.col("member_kind") == "method", F.concat("label", F.when(F.coalesce("member_value", F.lit("")) == "", "()").otherwise("($0)"))).otherwise(F.col("label"))
        listed = rows.select(F.col("member_kind").alias("kind"), "label", text.alias("insert_text"), "owner", F.col("member_types").alias("detail"), F.col("description").alias("documentation"), score.alias("score"), order.alias("kind_ord"), "place")
        return listed.orderBy("score", "kind_ord", "place", "label").drop("place")

    def _scope_node(self, uri: str, text: str, end: int) -> DataFrame:
        """The node of the expression that ends at an offset, as the scope of an access there."""
        line = text.count("\n", 0, end)
        at = N.position(F.lit(line), F.lit(end - (text.rfind("\n", 0, end) + 1)))
        rows = self.inference.nodes.where((F.col("uri") == uri) & (N.position(F.col("end_line"), F.col("end_char")) <= at))
        closing = self.catalog.rows.where((F.col("tag") == "arguments") & (F.col("uri") == uri) & (N.position(F.col("end_line"), F.col("end_char")) == at)).select("uri", F.col("value").cast("long").alias("node")).limit(1)
        called = rows.join(closing, KEYS, "left_semi").withColumn("first", F.lit(0))
        plain = rows.where(N.position(F.col("end_line"), F.col("end_char")) == at).withColumn("first", F.lit(1))
        best = called.unionByName(plain).orderBy("first", F.col("node").desc()).limit(1)
        low = F.lower("name")
        how = F.when(F.col("kind") == "this", "this").when((F.col("kind") == "class") & low.isin(*N.PARENT), "parent").when((F.col("kind") == "class") & low.isin(*N.RELATIVE), "relative").otherwise("name")
        return best.select(*KEYS, "inside", how.alias("how"))

    def completion(self, uri: str, text: str, offset: int) -> tuple[str | None, DataFrame | None]:
        """The variant that the text before a cursor asks for, and its items."""
        asked = context(text, offset)
        line = text.count("\n", 0, offset)
        character = offset - (text.rfind("\n", 0, offset) + 1)
        if asked.variant is None:
            return None, None
        if asked.variant in ("member", "scoped", "static_property"):
            kinds = {"member": ("method", "property"), "scoped": ("method", "property", "class_const"), "static_property": ("property",)}[asked.variant]
            return asked.variant, self.members_of(self._scope_node(uri, text, asked.scope_end), asked.word, kinds, asked.variant != "member")
        if asked.variant == "variable":
            return "variable", self.variables(uri, line, character, asked.word)
        kinds = {"class": ["class"], "interface": ["interface"], "trait": ["trait"], "type": ["class", "interface"], "name": ["class", "interface", "const", "define", "function"]}[asked.variant]
        return asked.variant, self.names(kinds, uri, line, character, asked.word)


def fuzzy(rows: DataFrame, name: str, word: str) -> DataFrame:
    """Rows whose name a word matches as a subsequence, with a score; all of them, with 0, for an empty word."""
    if not word:
        return rows.withColumn("score", F.lit(0).cast("long"))
    return rows.where(T.may_match(F.col(name), word)).withColumn("score", T.fuzzy(F.col(name), word)).where("score > 0")


def hover_text() -> Column:
    """Markdown of a symbol row: its declaration as code by kind, then its description with HTML tags as markdown."""
    value, types = F.coalesce("value", F.lit("")), F.col("types")
    call = F.concat(F.lit("("), value, F.lit(")"), F.when(types.isNotNull(), F.concat(F.lit(": "), types)).otherwise(F.lit("")))
    member = F.concat_ws(" ", N.visibility_text(F.col("visibility")), F.when(F.coalesce("is_static", F.lit(False)), F.lit("static")))
    code = (
        F.when(F.col("kind").isin("class", "interface", "trait"), F.concat_ws(" ", "modifier", "kind", "fqn"))
        .when(F.col("kind") == "function", F.concat(F.lit("function "), "fqn", call))
        .when(F.col("kind") == "method", F.concat(member, F.lit(" function "), "owner", F.lit("::"), "name", call))
        .when(F.col("kind") == "property", F.concat(F.concat_ws(" ", member, types, F.lit(None).cast("string")), F.lit(" "), "owner", F.lit("::"), "name"))
        .when(F.col("kind") == "class_const", F.concat(F.lit("const "), "owner", F.lit("::"), "name", F.lit(" = "), value))
        .when(F.col("kind") == "const", F.concat(F.lit("const "), "fqn", F.lit(" = "), value))
        .when(F.col("kind") == "define", F.concat(F.lit("define('"), "name", F.lit("', "), value, F.lit(")")))
        .otherwise(F.col("name"))
    )
    return F.concat_ws("\n\n", F.concat(F.lit("```php\n"), code, F.lit("\n```")), markdown(F.col("description")))


def markdown(html: Column) -> Column:
    """Simple HTML as markdown: emphasis, code, breaks and paragraphs; other tags go."""
    out = html
    for pattern, text in (
        (r"(?i)</?(?:b|strong)>", "**"), (r"(?i)</?(?:i|em)>", "_"), (r"(?i)</?(?:code|tt)>", "`"), (r"(?i)<li>\s*", "\n- "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?p>", "\n\n"), (r"<[^<>]*>", ""),
    ):
        out = F.regexp_replace(out, pattern, text)
    return F.trim(out)
