"""Kernels of name requests over any table: declarations by name, namespaces, aliases, uses, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def declared(uses: DataFrame, declarations: DataFrame, use: str, name: str) -> DataFrame:
    """Each use with every declaration of its name."""
    return uses.join(declarations, F.col(use) == F.col(name))


def used_by(declarations: DataFrame, uses: DataFrame, same: Column) -> DataFrame:
    """The declarations that some use stands in a relation with (equalities), each once."""
    return declarations.join(uses, same, "left_semi")


def namespace_index(namespaces: DataFrame, ns: str) -> DataFrame:
    """(scope, token, ns): each part of a namespace, lower-cased, under its parent scope."""
    cut = N.parts(F.col(ns))
    rows = namespaces.select(F.col(ns).alias("ns"), F.posexplode(cut).alias("i", "part"), cut.alias("ps"))
    scope = F.when(F.col("i") == 0, F.lit("")).otherwise(F.concat(F.lit("\\"), F.array_join(F.slice("ps", F.lit(1), F.col("i")), "\\")))
    return rows.select(scope.alias("scope"), F.lower("part").alias("token"), "ns").distinct()


def namespace_search(index: DataFrame, words: list[str]) -> DataFrame:
    """Rows of a namespace index whose token starts with one of some words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("token").startswith(w)
    return index.where(hit)


def aliased(uses: DataFrame, aliases: DataFrame, alias: str, target: str, namespace: Column) -> DataFrame:
    """Adds ``resolved``: what an alias stands for, else the name within a namespace."""
    return uses.join(aliases, alias, "left").withColumn("resolved", F.coalesce(target, N.qualify(F.col(alias), namespace))).drop(target)


def unread(declarations: DataFrame, uses: DataFrame, scope: list[str], at: str) -> DataFrame:
    """Declarations that no later use in their scope reads: the last use decides, so no inequality join."""
    last = uses.groupBy(*scope).agg(F.max(at).alias("_last"))
    return declarations.join(last, scope, "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(at))).drop("_last")


def answered_by(references: DataFrame, flagged: DataFrame, key: str, place: list[str]) -> DataFrame:
    """(place, n): references that a flagged declaration answers, by place; a declaration that is flagged twice counts once."""
    return references.join(flagged.select(key), key, "left_semi").groupBy(*place).agg(F.count("*").alias("n"))


def with_following(rows: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """(key, at, name): rows with the value of the row right behind them, by equality of places."""
    after = rows.select(key, (F.col(at) - 1).alias(at), F.col(value).alias(name))
    return rows.select(key, at).join(after, [key, at])


def zipped(rows: DataFrame, key: str, a: str, a_order: list[str], b: str, b_order: list[str]) -> DataFrame:
    """(key, i, a, b): two columns of a key's rows, each in its own order, side by side."""
    listed = lambda value, order: F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    lists = rows.groupBy(key).agg(F.arrays_zip(listed(a, a_order).alias("a"), listed(b, b_order).alias("b")).alias("z"))
    pairs = lists.select(key, F.posexplode("z").alias("i", "z"))
    return pairs.select(key, F.col("i").cast("long").alias("i"), F.col("z.a").alias(a), F.col("z.b").alias(b))
