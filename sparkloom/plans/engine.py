"""Catalog of a code base and the requests on it, composed of the kernels.

``Catalog`` derives every table from the extracted rows, so an index never holds a stale row: tokens, namespaces, references
and edges are views of the same frame.  Requests are DataFrames; several probes can be asked at once where a request takes a frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import tokens as T
from ..operators import hierarchy as H
from ..operators import lookup as L
from ..operators import references as R
from ..operators import search as S
from ..operators import sync as Y
from ..operators.tables import Buckets
from ..sources import php

#: Bundled sources have uris of this scheme.
STUBS = "loomstubs"
#: Kinds in the order of workspace results; members have an owner.
KINDS = ("class", "const", "class_const", "define", "function", "interface", "method", "property", "trait")
MEMBERS = ("class_const", "method", "property")
#: Names that are broadcast to the declarations; beyond, both sides are dealt by kind and key.
BROADCAST_PROBES = 50_000
#: Version of the tables that are written, and the oldest that is read; an older catalog is cleared.
VERSION, OLDEST = (0, 2, 0), (0, 2, 0)


def symbol_key(df: DataFrame) -> Column:
    """Kind, owner or name, and place: unique per declaration."""
    return F.concat_ws("\x00", "kind", "owner", "fqn", "uri", F.col("start_line").cast("string"), F.col("start_char").cast("string"))


class Catalog:
    """Tables of one code base."""

    def __init__(self, rows: DataFrame):
        self.rows, self._memo = rows, {}
        self.symbols = rows.where("tag = 'symbol'").withColumn("symbol_key", symbol_key(rows)).withColumn("lookup_key", F.when(F.col("kind") == "class", N.lookup_key(F.col("fqn"))).when(F.col("kind") == "method", F.lower("name")).otherwise(F.col("fqn")))
        self.edges = rows.where("tag = 'edge'").select("uri", "kind", F.col("fqn").alias("child"), F.col("value").alias("parent"), F.col("name").cast("int").alias("ord"))
        self.references = rows.where("tag = 'reference'").select("uri", F.col("fqn").alias("ref"), "start_line", "start_char", "end_line", "end_char")
        self.imports = rows.where("tag = 'import'")
        self.variables = rows.where("tag = 'variable'")
        self.accesses = rows.where("tag = 'access'")

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, stubs: str | None = None) -> Catalog:
        """The code below a folder, and bundled sources below another."""
        files = php.scan(spark, folder)
        if stubs:
            files = files.unionByName(php.scan(spark, stubs, STUBS))
        return cls(php.extract(files))

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(spark.createDataFrame([], php.SCHEMA))

    def save(self, path: str) -> None:
        """Parquet by tag, so each table is a partition that a reader prunes to; the version beside it."""
        self.rows.repartition("tag", "uri").sortWithinPartitions("fqn").write.mode("overwrite").partitionBy("tag").parquet(f"{path}/rows")
        write_version(self.rows.sparkSession, path, VERSION)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """The saved catalog; one of a version before OLDEST is cleared and comes back empty."""
        migrate(spark, path)
        return cls(spark.read.schema(php.SCHEMA).parquet(f"{path}/rows").select(*php.COLUMNS))

    @staticmethod
    def clear(spark: SparkSession, path: str) -> None:
        """Takes every row away; the catalog stays readable."""
        spark.createDataFrame([], php.SCHEMA).write.mode("overwrite").parquet(f"{path}/rows")

    def kept(self) -> Catalog:
        """The same catalog over rows written to the shared folder, so requests read tables and not the sources again."""
        path = f"{H.shared_folder(self.rows.sparkSession)}/catalog-{uuid.uuid4().hex}"
        self.rows.write.partitionBy("tag").parquet(path)
        return Catalog(self.rows.sparkSession.read.schema(php.SCHEMA).parquet(path).select(*php.COLUMNS))

    def with_document(self, uri: str, text: str) -> Catalog:
        """The catalog with a document as an editor holds it, read or not before."""
        spark = self.rows.sparkSession
        one = spark.createDataFrame([(uri, text)], "uri string, content string")
        return Catalog(Y.replace_documents(self.rows, php.extract(one), one.select("uri")))

    def document(self, uri: str, files: DataFrame | None = None) -> DataFrame:
        """All rows of a document: those held, else read from the files that are given."""
        held = self.rows.where(F.col("uri") == uri)
        if files is None or not held.isEmpty():
            return held
        return php.extract(files.where(F.col("uri") == uri))

    def manifest(self, uri: str) -> DataFrame:
        """The symbols that a document defines."""
        return self.symbols.where(F.col("uri") == uri).select("kind", "owner", "fqn", "symbol_key", "seq").orderBy("seq")

    def memo(self, name: str, make) -> DataFrame:
        """A frame that several requests use: made and kept once for this catalog."""
        if name not in self._memo:
            self._memo[name] = make().persist()
        return self._memo[name]

    def forget(self) -> None:
        for frame in self._memo.values():
            frame.unpersist()
        self._memo.clear()

    def sync_stubs(self, folder: str, stored: DataFrame) -> Catalog:
        """The catalog after the bundled sources whose digest differs from the stored one were read again; none of the others goes."""
        new = Y.changed(php.scan(self.rows.sparkSession, folder, STUBS), stored)
        return Catalog(Y.replace_documents(self.rows, php.extract(new), new.select("uri")))

    def sync(self, files: DataFrame, stored: DataFrame) -> Catalog:
        """The catalog after a new listing (uri, content, sha1): changed files are read again, missing ones go, the rest stays."""
        new = Y.changed(files, stored)
        gone = Y.reconcile(files, stored).where("status = 'delete'").select("uri")
        return Catalog(Y.replace_documents(self.rows, php.extract(new), new.select("uri").unionByName(gone)))

    @staticmethod
    def table(spark: SparkSession, folder: str, buckets: int = 64) -> Buckets:
        """A table for the rows of catalogs, in buckets of documents."""
        empty = spark.createDataFrame([], php.SCHEMA).select(*php.COLUMNS)
        return Buckets(spark, folder, "uri", empty.schema, buckets)

    @classmethod
    def sync_table(cls, table: Buckets, files: DataFrame, stored: DataFrame, batch: int | None = None) -> Catalog:
        """The catalog in a table after a new listing: only buckets of documents that changed or went are written, all at once, and the
        catalog reads files whatever the number of syncs before."""
        new = Y.changed(files, stored).persist()
        gone = Y.reconcile(files, stored).where("status = 'delete'").select("uri")
        try:
            table.replace(new.select("uri").unionByName(gone), php.extract(new).select(*php.COLUMNS), batch)
        finally:
            new.unpersist()
        return cls(table.read())

    def find(self, kind: str, fqn: str) -> DataFrame:
        """Declarations by name: classes and methods ignore the case of the last segment."""
        key = N.lookup_key(F.lit(fqn)) if kind == "class" else F.lower(F.lit(fqn)) if kind == "method" else F.lit(fqn)
        return self.symbols.where((F.col("kind") == kind) & (F.col("lookup_key") == key))

    def find_many(self, probes: DataFrame) -> DataFrame:
        """Declarations of many names at once: probes(kind, probe), looked up as find does, by equality of kind and key.

        Spark takes made-up rows for as small as the file they come from, and would hand millions of them through the driver: only counted ones are broadcast."""
        probe = F.col("probe")
        asked = probes.withColumn("lookup_key", F.when(F.col("kind") == "class", N.lookup_key(probe)).when(F.col("kind") == "method", F.lower(probe)).otherwise(probe))
        asked = F.broadcast(asked) if probes.count() <= BROADCAST_PROBES else asked.hint("merge")
        return asked.join(self.symbols, ["kind", "lookup_key"])

    def search_many(self, searches: DataFrame, limit: int = S.LIMIT) -> DataFrame:
        """Of each of many searches (search, kind, word_ord, word) the first symbols of its kind and whether they are all (search.search_many)."""
        name = F.when(F.col("kind") == "property", F.expr("substring(name, 2)")).otherwise(F.col("name"))
        index = S.token_index(self.symbols, name, F.col("symbol_key"), lambda n: F.transform(T.tokens(n), lambda t: F.concat("kind", F.lit(":"), t)))
        longest = max([len(k) for k in (*KINDS, "global")]) + 4
        return S.search_many(index, searches.withColumn("word", F.concat("kind", F.lit(":"), "word")).drop("kind"), limit, head=longest)

    def members(self, kind: str, owner: str, name: str = "", prefix: bool = False) -> DataFrame:
        rows = self.symbols.where((F.col("kind") == kind) & (F.col("owner") == owner))
        if not name:
            return rows
        want = F.lower(F.lit(name)) if kind == "method" else F.lit(name)
        have = F.lower("name") if kind == "method" else F.col("name")
        return rows.where(have.startswith(want) if prefix else have == want)

    def tokens(self, kind: str) -> DataFrame:
        name = F.when(F.col("kind") == "property", F.expr("substring(name, 2)")).otherwise(F.col("name"))
        return S.token_index(self.symbols.where(F.col("kind") == kind), name, F.col("symbol_key"), T.tokens)

    def _found(self, kind: str, keyword: str) -> tuple[DataFrame, list[str]]:
        """Symbols of a kind by a keyword, which may name a scope, and their order: its tokens are looked up in the token index."""
        scope, _, short = keyword.rpartition("\\")
        scope = "" if not scope and not keyword.startswith("\\") else scope or "\\"
        words = [t.decode() for t in T.exact_tokens(short.lower().encode())] or [""]
        owner = F.col("owner") if kind in MEMBERS else F.col("namespace") if kind in ("class", "interface", "function") else F.lit("")
        symbols = self.symbols.where(F.col("kind") == kind)
        if scope and kind == "class":
            root = "\\" if scope == "\\" else ("" if scope.startswith("\\") else "\\") + scope + "\\"
            return symbols.where(F.col("fqn").startswith(root) & F.contains("name", F.lit(short))), ["lookup_key", "uri"]
        if not short and kind in ("class_const", "property") and scope:
            return symbols.where(owner == scope), ["name"]
        if not short and kind == "method":
            return symbols.limit(0), ["name"]
        found = S.token_search(self.tokens(kind), words, None).join(symbols, "symbol_key")
        return (found.where(owner == scope) if scope else found), ["word_ord", "token", "symbol_key"]

    def search(self, kind: str, keyword: str, limit: int = S.LIMIT) -> DataFrame:
        """The first symbols of a kind that a keyword finds."""
        found, order = self._found(kind, keyword)
        return found.orderBy(*order).limit(limit).select(self.symbols.columns)

    def search_limited(self, kind: str, keyword: str, limit: int = S.LIMIT) -> DataFrame:
        """As search, with `is_complete`: whether these are all."""
        found, order = self._found(kind, keyword)
        return S.limited(found, order, limit).select(*self.symbols.columns, "is_complete")

    def globals(self, name: str) -> DataFrame:
        """Global variables of a name."""
        return self.symbols.where((F.col("kind") == "global") & (F.col("name") == name))

    def fuzzy_members(self, kind: str, classes: DataFrame, word: str) -> DataFrame:
        """Members of classes or interfaces with those they inherit that a word matches, with its score; all for an empty word."""
        from .cursor import fuzzy

        return fuzzy(self.inherited(kind, classes), "name", word)

    def relations(self, classes: DataFrame) -> DataFrame:
        """(one, other): pairs of a class (column ``seed``) and those it inherits from, both ways round."""
        up = H.whole_closure(self.edges.where("kind = 'extends'").select("child", "parent"), classes).where("depth > 0")
        return up.select(F.col("seed").alias("one"), F.col("node").alias("other")).unionByName(up.select(F.col("node").alias("one"), F.col("seed").alias("other"))).distinct()

    def workspace_symbols(self, keyword: str, limit: int = S.LIMIT) -> DataFrame:
        if not keyword:
            return S.union_kinds([(k, self.symbols.limit(0).drop("kind")) for k in KINDS])
        return S.union_kinds([(k, self.search(k, keyword, limit).drop("kind")) for k in KINDS])

    def filters(self) -> DataFrame:
        """The membership filter of each document's references, to be kept beside the catalog."""
        return R.filters(self.references, "uri", "ref")

    def find_filtered(self, stored: DataFrame, refs: list[str]) -> DataFrame:
        """Places of references, by the filters kept of the documents first."""
        return R.search(self.references, stored, "uri", "ref", refs)

    def namespaces(self) -> DataFrame:
        """(scope, token, ns): each part of a namespace under its parent scope."""
        ns = self.rows.where("tag = 'namespace' and fqn <> '\\\\'").select("fqn").distinct()
        return L.namespace_index(ns, "fqn")

    def find_references(self, ref: str) -> DataFrame:
        return self.references.where(F.col("ref") == ref)

    def inherited(self, kind: str, classes: DataFrame) -> DataFrame:
        """Members of classes (a column ``seed``) with those they inherit: seed, depth, phase, seq order and the member.

        Classes come before interfaces; a class's own members before those of the traits it uses; traits give methods only."""
        line = self.edges.where("kind = 'extends'").select("child", "parent")
        up = H.whole_closure(line, classes)
        faces = self.edges.where("kind = 'implements'").select(F.col("child").alias("node"), F.col("parent").alias("face"))
        seeds = up.join(faces, "node").select("seed", "face", "depth")
        reach = H.whole_closure(line, seeds.select(F.col("face").alias("seed"))).withColumnsRenamed({"seed": "face", "depth": "more"})
        all_up = up.select("seed", F.col("node").alias("of"), F.lit(0).alias("phase"), "depth", F.lit(0).alias("ord"))
        if kind == "method":
            traits = self.edges.where("kind = 'use'").select(F.col("child").alias("node"), F.col("parent").alias("of"), (F.col("ord") + 1).alias("ord"))
            all_up = all_up.unionByName(up.join(traits, "node").select("seed", "of", F.lit(0).alias("phase"), "depth", "ord"))
        all_up = all_up.unionByName(seeds.join(reach, "face").select("seed", F.col("node").alias("of"), F.lit(1).alias("phase"), (F.col("depth") + F.col("more")).alias("depth"), F.lit(0).alias("ord")))
        nearest = H.first_wins(all_up, ["seed", "of"], ["phase", "depth", "ord"])
        return nearest.join(self.symbols.where(F.col("kind") == kind), F.col("of") == F.col("owner"))

    ORDER = ("phase", "depth", "ord", "uri", "seq")

    def first_members(self, kind: str, classes: DataFrame, own: Column, handed: Column) -> DataFrame:
        """Of each name the first of what ``inherited`` gives, for most classes at once: members that are ``own`` count for their class, those
        ``handed`` on for all that reach it.  No row is made for each class and each one above it: only first rows go down."""
        line, ids = self.edges.where("kind = 'extends'").select("child", "parent"), ["uri", "seq"]
        rows = self.symbols.where(F.col("kind") == kind).select(F.col("owner").alias("of"), "name", *ids, *[F.coalesce(rule, F.lit(False)).alias(n) for rule, n in ((own, "_own"), (handed, "_handed"))])
        given, at = rows.where("_handed").drop("_own", "_handed"), [F.col("depth").cast("long").alias("depth"), F.col("ord").cast("int").alias("ord")]
        start = given.select(F.col("of").alias("node"), "name", "of", F.lit(0).alias("phase"), F.lit(0).alias("depth"), F.lit(0).alias("ord"), *ids)
        if kind == "method":
            traits = self.edges.where("kind = 'use'").select(F.col("child").alias("node"), F.col("parent").alias("of"), F.lit(0).alias("phase"), F.lit(0).alias("depth"), (F.col("ord") + 1).alias("ord"))
            start = start.unionByName(traits.join(given, "of"))
        faces = self.edges.where("kind = 'implements'").select(F.col("child").alias("node"), F.col("parent").alias("face"))
        reach = H.whole_closure(line, faces.select(F.col("face").alias("seed"))).select(F.col("seed").alias("face"), F.col("node").alias("of"), F.lit(1).alias("phase"), "depth", F.lit(0).alias("ord"))
        start = start.unionByName(faces.join(H.first_wins(reach.join(given, "of"), ["face", "name"], ["depth", "uri", "seq"]), "face").drop("face"))
        columns, order = ["node", "name", "of", "phase", "depth", "ord", *ids], list(self.ORDER)
        found = H.first_above(line, start.withColumns({"depth": at[0], "ord": at[1]}).select(columns), ["name"], order)
        alone = rows.where("_own AND NOT _handed").select(F.col("of").alias("node"), "name", "of", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("ord"), *ids)
        wanted = found.unionByName(alone).join(classes.select(F.col("seed").alias("node")).distinct(), "node", "left_semi")
        first = H.first_wins(wanted, ["node", "name"], order).select(F.col("node").alias("seed"), "of", "phase", "depth", "ord", *ids)
        whole = first.join(self.symbols.where(F.col("kind") == kind).dropDuplicates(ids), ids)
        return whole.select("seed", "name", "of", "phase", "depth", "ord", *[c for c in self.symbols.columns if c != "name"])

    def _many(self, classes: DataFrame) -> bool:
        return H.most(self.edges.where("kind = 'extends'"), classes.select("seed").distinct())

    def instance_members(self, kind: str, classes: DataFrame, current: str = "", via_this: bool = False) -> DataFrame:
        """What ``$x->`` reaches: first of each name that the access rule allows."""
        if not current and self._many(classes):  # else the rule differs by the class asked for
            rule = H.instance_access(F.col("visibility"), F.col("owner"), F.lit(current), F.lit(False), F.lit(via_this))
            return self.first_members(kind, classes, rule, rule)
        rows = self.inherited(kind, classes)
        ok = H.instance_access(F.col("visibility"), F.col("owner"), F.lit(current), F.col("seed") == current, F.lit(via_this))
        return H.first_wins(rows.where(ok), ["seed", "name"], list(self.ORDER))

    def static_members(self, kind: str, classes: DataFrame, current: str = "", how: str = "name", related: bool = False) -> DataFrame:
        """What ``X::`` reaches; how: parent, relative or name. Constants count as static.

        Protected members of classes that the named one inherits from are reached too: constants always, others where ``related`` asks for it."""
        static, kin = F.lit(True) if kind == "class_const" else F.coalesce("is_static", F.lit(False)), related or kind == "class_const"
        if self._many(classes):
            own, handed = (H.static_access(F.col("visibility"), static, F.col("owner"), F.lit(current), F.lit(how), F.lit(mine), F.lit(kin and not mine)) for mine in (True, False))
            return self.first_members(kind, classes, own, handed)
        rows = self.inherited(kind, classes).withColumn("related", (F.col("of") != F.col("seed")) & F.lit(kin))
        ok = H.static_access(F.col("visibility"), static, F.col("owner"), F.lit(current), F.lit(how), F.col("seed") == F.col("owner"), F.col("related"))
        return H.first_wins(rows.where(ok).drop("related"), ["seed", "name"], list(self.ORDER))

    def constructor(self, classes: DataFrame) -> DataFrame:
        rows = self.inherited("method", classes).where("lower(name) = '__construct' and visibility = 0")
        return H.first_wins(rows, ["seed"], list(self.ORDER))

    def definitions(self) -> DataFrame:
        """Every access with its declarations: functions, constants and classes by name."""
        kinds = F.when(F.col("kind").isin("class", "new"), F.array(*[F.lit(k) for k in ("class", "interface", "trait")])).when(F.col("kind") == "function", F.array(F.lit("function"))).otherwise(F.array(F.lit("const"), F.lit("define")))
        asks = self.accesses.where(F.col("kind").isin("class", "new", "function", "const")).withColumn("want", F.explode(kinds))
        key = F.when(F.col("want") == "class", N.lookup_key(F.col("fqn"))).otherwise(F.col("fqn"))
        asks = asks.select("uri", F.col("start_line").alias("line"), F.col("start_char").alias("character"), F.col("name").alias("used"), "want", key.alias("key"))
        s = self.symbols.select(F.col("kind").alias("want"), F.col("lookup_key").alias("key"), F.col("uri").alias("target"), "fqn", "start_line", "start_char", "deprecated", "symbol_key")
        return asks.join(s, ["want", "key"])

    def deprecated_references(self) -> DataFrame:
        """One row per access that some deprecated declaration answers."""
        return H.first_wins(self.definitions().where("deprecated is not null").select("uri", "line", "character", "fqn", "deprecated"), ["uri", "line", "character"], ["fqn"])

    def unused_imports(self) -> DataFrame:
        """Imports that no name of their file goes through."""
        used = self.rows.where("tag = 'use'").select("uri", "kind", F.lower("name").alias("alias"), "namespace").distinct()
        return self.imports.withColumn("alias", F.lower("name")).join(used, ["uri", "kind", "alias", "namespace"], "left_anti").drop("alias")

    def unused_variables(self) -> DataFrame:
        """Declarations that no later use of the name in their scope reads: the last use decides, so no inequality join."""
        scope = ["uri", "value", "name"]
        return L.unread(self.variables.where("kind = 'declare'"), self.variables.where("kind = 'use'"), scope, "seq")

    def visible_variables(self, uri: str, scope: str, line: int, character: int) -> DataFrame:
        """The last version of each variable before a position."""
        at = N.position(F.col("start_line"), F.col("start_char"))
        rows = self.variables.where((F.col("uri") == uri) & (F.col("value") == scope) & F.col("kind").isin("declare", "parameter") & (at < N.position(F.lit(line), F.lit(character))))
        return rows.groupBy("name").agg(F.max_by(F.struct("types", "start_line", "start_char"), "seq").alias("v")).select("name", "v.*")

    def signature(self, kind: str, fqn: str) -> DataFrame:
        return self.find(kind, fqn).select(F.concat("name", F.lit("("), F.coalesce("value", F.lit("")), F.lit(")")).alias("label"), F.split("value", ", ").alias("parameters"), "description")

    def hover(self, kind: str, fqn: str) -> DataFrame:
        label = F.concat_ws(" ", F.col("modifier"), F.lit(kind), F.col("fqn"))
        return self.find(kind, fqn).select(F.concat_ws("\n\n", F.concat(F.lit("```php\n"), label, F.lit("\n```")), F.col("description")).alias("markdown"))

    def outline(self, uri: str) -> DataFrame:
        """Symbols of a file with the symbol they stand in."""
        return self.symbols.where(F.col("uri") == uri).select("kind", "name", F.col("owner").alias("parent"), "start_line", "end_line", "seq").orderBy("seq")

    def errors(self) -> DataFrame:
        return self.rows.where("tag = 'error'")


def write_version(spark: SparkSession, path: str, version: tuple[int, ...]) -> None:
    spark.createDataFrame([(".".join(map(str, version)),)], "version string").write.mode("overwrite").json(f"{path}/version")


def read_version(spark: SparkSession, path: str) -> str:
    """The version written beside a catalog; v0.0.0 where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("version string").json(f"{path}/version").first()
    except AnalysisException:
        row = None
    return row["version"] if row and row["version"] else "0.0.0"


def migrate(spark: SparkSession, path: str) -> bool:
    """Clears a catalog older than OLDEST and writes the version; whether it did. A version that cannot be read changes nothing."""
    text = read_version(spark, path).lstrip("v")
    if not all(p.isdigit() for p in text.split(".")) or tuple(map(int, text.split("."))) >= OLDEST:
        return False
    Catalog.clear(spark, path)
    write_version(spark, path, VERSION)
    return True


class Workspace:
    """Catalogs of several folders, by the root that a document's uri begins with."""

    #: What the requests of an opened workspace cover.
    CAPABILITIES = ("definition", "hover", "signatures", "references", "rename", "completion", "symbols", "outline", "diagnostics")

    def __init__(self, spark: SparkSession):
        self.spark, self.catalogs, self.streams = spark, {}, {}

    def add(self, root: str, folder: str, saved: str | None = None, stubs: str | None = None) -> Catalog:
        """Reads a folder (or what was saved of it, after the version gate) and serves it under a root."""
        if saved:
            catalog = Catalog.load(self.spark, saved)
            if not catalog.rows.isEmpty():
                self.catalogs[root] = catalog
                return catalog
        catalog = Catalog.of_folder(self.spark, folder, stubs)
        if saved:
            catalog.save(saved)
            catalog = Catalog.load(self.spark, saved)
        self.catalogs[root] = catalog if saved else catalog.kept()
        return self.catalogs[root]

    def remove(self, root: str) -> None:
        """Ends what watches a root and lets go of its catalog."""
        for stream in self.streams.pop(root, []):
            stream.stop()
        if root in self.catalogs:
            self.catalogs.pop(root).forget()

    def watch(self, root: str, stream) -> None:
        """A running stream that is stopped with its root."""
        self.streams.setdefault(root, []).append(stream)

    def route(self, uri: str) -> Catalog | None:
        """The catalog of the first root (in the order they were added) that the uri begins with."""
        return next((c for root, c in self.catalogs.items() if uri.startswith(root)), None)

    def routed(self, documents: DataFrame, uri: str = "uri") -> DataFrame:
        return S.route(documents, uri, list(self.catalogs))

    def open(self, roots: dict[str, str]) -> tuple[str, ...]:
        """Adds all folders; gives what can be asked."""
        for root, folder in roots.items():
            self.add(root, folder)
        return self.CAPABILITIES

    def close(self) -> None:
        for root in [*self.catalogs, *self.streams]:
            self.remove(root)
