"""Types of expressions and what rests on them, for all nodes of a code base at once.

Nodes start with the types that their text states; each round hands the types found in the last one over the links: to
variables, loop elements, and through the members that the access rules allow to accesses.  A round is a few equality joins on
(file, node) and on (class, member name), and the rounds end when nothing new is found, which takes as many as the longest
chain of accesses.  The inherited members of all classes are made once.  Rounds are written to the shared folder.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import hierarchy as H

KEYS = ["uri", "node"]
TYPE = ["fqn", "level"]
MEMBER_OF = {"method": "method", "static_method": "method", "property": "property", "static_property": "property", "class_const": "class_const"}
TARGET = ["target_uri", "target_line", "target_character", "target_end_line", "target_end_character"]


def _written(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again: rounds keep short plans and survive lost executors."""
    path = f"{H.shared_folder(df.sparkSession)}/inference-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _typed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Each of the types in a text as a row: fqn, level, pos."""
    rows = df.where(f"{text} is not null and {text} <> ''").select(*keep, F.posexplode(F.split(text, r"\|")).alias("pos", "t"))
    t = N.type_struct(F.col("t"))
    return rows.select(*keep, t["fqn"].alias("fqn"), t["array_level"].alias("level"), "pos")


class Inference:
    """Resolved types, members and definitions of a catalog; each table is made once, when first asked for."""

    def __init__(self, catalog):
        self.catalog = catalog
        rows = catalog.rows
        self.nodes = rows.where("tag = 'expr'").select(
            "uri", F.col("seq").alias("node"), "kind", "name", F.col("value").cast("long").alias("scope"), "types", F.col("fqn").alias("candidates"), F.coalesce("owner", F.lit("")).alias("inside"),
            F.coalesce("modifier", F.lit("name")).alias("how"), "start_line", "start_char", "end_line", "end_char",
        )
        self.classes = catalog.symbols.where("kind in ('class', 'interface', 'trait')").select(F.col("kind").alias("class_kind"), F.col("fqn").alias("seed"), F.col("lookup_key").alias("class_key")).distinct()

    @cached_property
    def members(self) -> DataFrame:
        """Every member that a class, interface or trait has or inherits: seed, member_kind, key and the symbol with its order."""
        found = None
        for kind in ("method", "property", "class_const"):
            rows = self.catalog.inherited(kind, self.classes.select("seed"))
            key = F.lower("name") if kind == "method" else F.col("name")
            rows = rows.select(
                "seed", F.lit(kind).alias("member_kind"), key.alias("key"), F.col("name").alias("member"), "owner", F.col("types").alias("member_types"), "visibility", F.coalesce("is_static", F.lit(kind == "class_const")).alias("is_static"),
                F.struct("phase", "depth", "ord", "uri", "seq").alias("place"), "symbol_key", F.col("uri").alias("target_uri"), F.col("start_line").alias("target_line"), F.col("start_char").alias("target_character"),
                F.col("end_line").alias("target_end_line"), F.col("end_char").alias("target_end_character"), "description", "deprecated", F.col("value").alias("member_value"),
            )
            found = rows if found is None else found.unionByName(rows)
        return _written(found.join(self.classes.select("seed", "class_kind"), "seed"))

    def classes_of(self, typed: DataFrame) -> DataFrame:
        """Rows with a type, with the classes, interfaces and traits of that name; classes ignore the case of the last segment."""
        key = F.when(F.col("class_kind") == "class", F.col("class_key")).otherwise(F.col("seed"))
        known = self.classes.select("seed", "class_kind", F.explode(F.array_distinct(F.array(key, F.col("seed")))).alias("asked"))
        asked = typed.where("level = 0").withColumn("asked", F.explode(F.array_distinct(F.array("fqn", N.lookup_key(F.col("fqn"))))))
        joined = asked.join(known, "asked").where((F.col("class_kind") == "class") | (F.col("asked") == F.col("fqn")))
        return joined.drop("asked").dropDuplicates([*typed.columns, "seed", "class_kind"])

    @staticmethod
    def allowed(kind: Column) -> Column:
        """The access rule of a node (inside, how) for a member (visibility, is_static, owner) of a class (seed); constants of related classes count."""
        related = (F.col("member_kind") == "class_const") & (F.col("seed") != F.col("owner"))
        instance = H.instance_access(F.col("visibility"), F.col("owner"), F.col("inside"), F.col("seed") == F.col("inside"), F.col("how") == "this", related)
        static = H.static_access(F.col("visibility"), F.col("is_static"), F.col("owner"), F.col("inside"), F.col("how"), F.col("seed") == F.col("owner"), related)
        return F.when(kind.isin("method", "property"), instance).otherwise(static)

    def reached(self, scoped: DataFrame) -> DataFrame:
        """Of accesses with a type of their scope (uri, node, kind, name, inside, how, fqn, level, ord) the members that they reach."""
        key = F.when(F.col("kind").isin("method", "static_method"), F.lower("name")).when(F.col("kind") == "property", F.concat(F.lit("$"), "name")).otherwise(F.col("name"))
        member_kind = F.when(F.col("kind").isin("method", "static_method"), "method").when(F.col("kind").isin("property", "static_property"), "property").otherwise("class_const")
        asked = self.classes_of(scoped.withColumns({"key": key, "member_kind": member_kind})).drop("class_kind")
        hit = asked.join(self.members, ["seed", "member_kind", "key"]).where(self.allowed(F.col("kind")))
        return H.first_wins(hit, [*KEYS, "fqn", "level", "seed", "member"], ["place"])

    @cached_property
    def functions(self) -> DataFrame:
        """Function calls with the declarations of the first of their possible names that exists."""
        asked = self.nodes.where("kind = 'function'").select(*KEYS, F.posexplode(F.split("candidates", r"\|")).alias("choice", "fqn"))
        known = self.catalog.symbols.where("kind = 'function'").select(
            "fqn", F.col("name").alias("member"), F.col("types").alias("member_types"), "symbol_key", F.col("uri").alias("target_uri"), F.col("start_line").alias("target_line"), F.col("start_char").alias("target_character"),
            F.col("end_line").alias("target_end_line"), F.col("end_char").alias("target_end_character"), "description", "deprecated", F.col("value").alias("member_value"),
        )
        hit = asked.join(known, "fqn")
        return hit.join(hit.groupBy(*KEYS).agg(F.min("choice").alias("choice")), [*KEYS, "choice"])

    @cached_property
    def _solved(self) -> tuple[DataFrame, DataFrame]:
        """(uri, node, fqn, level, ord) and the members that accesses reach."""
        nodes = self.nodes
        first = lambda df: df.select(*KEYS, "fqn", "level", F.array("pos").alias("ord"))
        start = first(_typed(nodes, "types", *KEYS)).unionByName(first(_typed(self.functions, "member_types", *KEYS)))
        globals_ = _typed(self.catalog.symbols.where("kind = 'global'"), "types", "name").withColumnRenamed("name", "variable")
        loose = nodes.where("kind = 'global' or (kind = 'variable' and how = 'global')").select(*KEYS, F.col("name").alias("variable"))
        start = start.unionByName(first(loose.join(globals_, "variable")))
        links = self.catalog.rows.where("tag = 'link'").select("uri", F.col("value").cast("long").alias("node"), "owner", F.concat(F.lit("$"), "name").alias("member"))
        derived = nodes.where("scope is not null and kind in ('variable', 'element', 'global')").select("uri", F.col("scope"), F.col("node").alias("to"), F.when(F.col("kind") == "element", 1).otherwise(0).alias("down"))
        accesses = nodes.where(F.col("scope").isNotNull() & F.col("kind").isin(*MEMBER_OF)).select("uri", "scope", F.col("node").alias("to"), "kind", "name", "inside", "how")

        def once(df: DataFrame) -> DataFrame:
            return df.groupBy(*KEYS, *TYPE).agg(F.min("ord").alias("ord"))

        typed, members, extras = [], [], None
        frontier = _written(once(start))
        while not frontier.isEmpty():
            typed.append(frontier)
            over = frontier.withColumnRenamed("node", "scope")
            passed = derived.join(over, ["uri", "scope"]).where("level >= down").select("uri", F.col("to").alias("node"), "fqn", (F.col("level") - F.col("down")).alias("level"), "ord")
            hit = _written(self.reached(accesses.join(over, ["uri", "scope"]).drop("scope").withColumnRenamed("to", "node")))
            members.append(hit)
            own = _typed(hit, "member_types", *KEYS, "seed", "ord").select(
                *KEYS, F.when(F.col("fqn").isin("static", "$this"), F.col("seed")).otherwise(F.col("fqn")).alias("fqn"), "level", F.concat("ord", F.array("pos")).alias("ord")
            )
            fresh = links.join(frontier, KEYS).select("owner", "member", *TYPE).distinct()
            fresh = _written(fresh if extras is None else fresh.join(extras, ["owner", "member", *TYPE], "left_anti"))
            every = members[0]
            for m in members[1:]:
                every = every.unionByName(m)
            assigned = [(every, fresh)] + ([(hit, extras)] if extras is not None else [])
            new = passed.unionByName(own)
            for m, e in assigned:
                more = m.where("member_kind = 'property'").select(*KEYS, "owner", "member", "ord").join(e, ["owner", "member"])
                new = new.unionByName(more.select(*KEYS, *TYPE, F.concat("ord", F.array(F.lit(1000))).alias("ord")))
            extras = fresh if extras is None else extras.unionByName(fresh)
            known = typed[0]
            for t in typed[1:]:
                known = known.unionByName(t)
            frontier = _written(once(new).join(known.select(*KEYS, *TYPE), [*KEYS, *TYPE], "left_anti"))
        all_typed, all_members = (typed or [frontier])[0], members[0] if members else None
        for t in typed[1:]:
            all_typed = all_typed.unionByName(t)
        for m in members[1:]:
            all_members = all_members.unionByName(m)
        if all_members is None:
            all_members = self.reached(accesses.limit(0).withColumnRenamed("to", "node").join(frontier.drop("node"), "uri").drop("scope"))
        return all_typed, all_members

    @property
    def types(self) -> DataFrame:
        """(uri, node, fqn, level): the types of every node, the first of each name in order."""
        return H.first_wins(self._solved[0], [*KEYS, "fqn"], ["ord", "level"])

    @property
    def reached_members(self) -> DataFrame:
        """Every access with each member that it reaches, per type of its scope."""
        return self._solved[1]

    @cached_property
    def constructors(self) -> DataFrame:
        """(seed and the first public constructor of each class, own or inherited)."""
        rows = self.members.where("member_kind = 'method' and key = '__construct' and visibility = 0")
        return H.first_wins(rows, ["seed"], ["place"])

    @property
    def _new(self) -> DataFrame:
        made = self.nodes.where("kind = 'new'").select(*KEYS, F.col("types").alias("fqn"), F.lit(0).alias("level"))
        return self.classes_of(made).where("class_kind = 'class'").drop("class_kind", "level", "fqn")

    @property
    def callables(self) -> DataFrame:
        """(uri, node, what is called): the declarations whose parameters an argument list fills."""
        take = ["symbol_key", "member", "member_value", "member_types", "description", *TARGET]
        methods = self.reached_members.where("member_kind = 'method'").select(*KEYS, "ord", *take)
        functions = self.functions.select(*KEYS, F.array(F.lit(0)).alias("ord"), *take)
        made = self._new.join(self.constructors, "seed").select(*KEYS, F.array(F.lit(0)).alias("ord"), *take)
        return H.first_wins(methods.unionByName(functions).unionByName(made), [*KEYS, "symbol_key"], ["ord"])

    @cached_property
    def definitions(self) -> DataFrame:
        """(uri, node, ord, fqn or owner, member, place): where each access is declared."""
        place = [F.col(c) for c in TARGET]
        s = self.catalog.symbols.select(
            F.col("kind").alias("want"), "fqn", F.col("lookup_key"), F.col("uri").alias("target_uri"), F.col("start_line").alias("target_line"), F.col("start_char").alias("target_character"),
            F.col("end_line").alias("target_end_line"), F.col("end_char").alias("target_end_character"), "deprecated", "symbol_key",
        )
        out = [*KEYS, "ord", "fqn", "member", "deprecated", "symbol_key", *TARGET]
        members = self.reached_members.select(*KEYS, "ord", F.col("owner").alias("fqn"), "member", "deprecated", "symbol_key", *place)
        functions = self.functions.select(*KEYS, F.array("choice").alias("ord"), "fqn", "member", "deprecated", "symbol_key", *place)
        kinds = F.when(F.col("kind") == "interface", F.array(F.lit("interface"))).when(F.col("kind") == "trait", F.array(F.lit("trait"))).when(F.col("kind") == "type", F.array(F.lit("class"), F.lit("interface"))).otherwise(F.array(F.lit("class")))
        named = _typed(self.nodes.where("kind in ('class', 'type', 'interface', 'trait')").withColumn("kinds", kinds), "types", *KEYS, "kinds")
        named = named.select(*KEYS, "fqn", "pos", F.explode("kinds").alias("want")).withColumn("lookup_key", F.when(F.col("want") == "class", N.lookup_key(F.col("fqn"))).otherwise(F.col("fqn")))
        named = named.drop("fqn").join(s, ["want", "lookup_key"]).select(*KEYS, F.array("pos").alias("ord"), "fqn", F.lit("").alias("member"), "deprecated", "symbol_key", *place)
        consts = self.nodes.where("kind = 'const'").select(*KEYS, F.posexplode(F.split("candidates", r"\|")).alias("choice", "fqn")).join(s.where("want in ('const', 'define')").drop("lookup_key"), "fqn")
        consts = consts.join(consts.groupBy(*KEYS).agg(F.min("choice").alias("choice")), [*KEYS, "choice"]).select(*KEYS, F.array("choice").alias("ord"), "fqn", F.lit("").alias("member"), "deprecated", "symbol_key", *place)
        # a constructor that the class itself declares, else the class
        own = self.constructors.where("owner = seed").select("seed", F.struct("deprecated", "symbol_key", *TARGET).alias("c"), "member")
        made = self._new.join(s.where("want = 'class'").select(F.col("fqn").alias("seed"), F.struct("deprecated", "symbol_key", *TARGET).alias("k")), "seed").join(own, "seed", "left")
        made = made.select(*KEYS, F.array(F.lit(0)).alias("ord"), F.col("seed").alias("fqn"), F.coalesce("member", F.lit("")).alias("member"), F.coalesce("c", "k").alias("t")).select(*KEYS, "ord", "fqn", "member", "t.*")
        found = None
        for part in (members, functions, named, consts, made):
            found = part.select(*out) if found is None else found.unionByName(part.select(*out))
        return _written(H.first_wins(found.where(N.navigatable(F.col("target_uri"))), [*KEYS, "symbol_key"], ["ord"]))
