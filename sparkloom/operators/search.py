"""Keyed lookups, token index and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a search returns at most unless told otherwise (a search result is a top-k report).
LIMIT = 1000


def prefix_scan(df: DataFrame, key: str, prefix: str, limit: int | None = None) -> DataFrame:
    """Rows whose key starts with a prefix, in key order where a limit stops the scan; the prefix reaches the file scan."""
    found = df.where(F.col(key).startswith(prefix))
    return found.orderBy(key).limit(limit) if limit is not None else found


def layered(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of each key the row of the first layer that has it."""
    rows = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("_layer", F.lit(i))
        rows = layer if rows is None else rows.unionByName(layer)
    others = [c for c in rows.columns if c not in (*keys, "_layer")]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "_layer").alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def last_operation(ops: DataFrame, keys: list[str], order: list[str], kind: Column) -> DataFrame:
    """A batch of puts and deletes: of each key the last operation wins; deleted keys are gone."""
    others = [c for c in ops.columns if c not in keys]
    best = ops.withColumn("_put", kind).groupBy(*keys).agg(F.max_by(F.struct(*others, "_put"), F.struct(*order)).alias("_r"))
    return best.where("_r._put").select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def route(df: DataFrame, uri: str, roots: list[str]) -> DataFrame:
    """Adds the first root (in order) that is a prefix of the uri; roots are a literal list, so no join."""
    first = F.coalesce(*[F.when(F.col(uri).startswith(r), F.lit(r)) for r in roots])
    return df.withColumn("root", first)


def token_index(symbols: DataFrame, name: Column, key: Column, tokens) -> DataFrame:
    """(token, symbol_key): a row per distinct token of each symbol's name."""
    return symbols.select(key.alias("symbol_key"), F.explode(tokens(name)).alias("token"))


def token_search(index: DataFrame, words: list[str], limit: int | None = LIMIT) -> DataFrame:
    """(symbol_key, word_ord, token): symbols with a token that starts with a word, best first, each once.

    Words are literals, so this is one scan with a pushed-down prefix filter, not a nested-loop join; the per-symbol best
    is an aggregate with partial sums, and order plus limit run as a top-k."""
    ordinal = F.coalesce(*[F.when(F.col("token").startswith(w), F.lit(i)) for i, w in enumerate(words)])
    hits = index.where(ordinal.isNotNull()).groupBy("symbol_key").agg(F.min(F.struct(ordinal.alias("word_ord"), "token")).alias("b"))
    found = hits.select("symbol_key", F.col("b.word_ord").cast("long").alias("word_ord"), F.col("b.token").alias("token"))
    ordered = found.orderBy("word_ord", "token", "symbol_key")
    return ordered.limit(limit) if limit is not None else ordered


def limited(found: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows and whether they are all: one row more than asked tells, so nothing is counted."""
    head = found.orderBy(*order).limit(n + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    every = Window.partitionBy(F.lit(0))
    return head.withColumn("is_complete", F.count("*").over(every) <= n).where(F.col("_n") <= n).drop("_n")


def union_kinds(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """Searches of several kinds, one after the other."""
    out = None
    for i, (name, df) in enumerate(kinds):
        df = df.withColumns({"kind": F.lit(name), "kind_ord": F.lit(i).cast("long")})
        out = df if out is None else out.unionByName(df)
    return out


def in_set(column: Column, values: list) -> Column:
    """Membership in a list, each value once."""
    return column.isin(*dict.fromkeys(values)) if values else F.lit(False)


def unique_first(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the first row in order, as the values of a completion are listed once."""
    others = [c for c in found.columns if c != key]
    best = found.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in others])


def prefix_pairs(words: DataFrame, tokens: DataFrame, head: int = 3) -> DataFrame:
    """(word, token) of different words and tokens where the token starts with the word, by equality of bounded prefixes.

    Both sides are cut to the first ``head`` characters; a word that is shorter meets the tokens' prefixes of its own length, so
    tokens are listed once for each length that occurs among the words (``head + 1`` at most)."""
    words = words.select("word").where("word IS NOT NULL").distinct()
    lengths = sorted(r.n for r in words.select(F.least(F.length("word"), F.lit(head)).alias("n")).distinct().collect())
    heads = F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("n")
    heads = tokens.select("token").distinct().select("token", heads).where(F.col("n") <= F.length("token")).select("token", F.substring("token", F.lit(1), F.col("n")).alias("head"))
    return words.withColumn("head", F.substring("word", 1, head)).join(heads, "head").where(F.col("token").startswith(F.col("word"))).select("word", "token")


def search_many(index: DataFrame, searches: DataFrame, limit: int = LIMIT, head: int = 3) -> DataFrame:
    """(search, symbol_key, word_ord, token, place, is_complete): of each search its first ``limit`` symbols and whether they are all.

    searches(search, word_ord, word): a search has some words; a symbol is found by its least (word_ord, token), and symbols are listed by
    that and their key.  index(token, symbol_key).  Whole results need no more than this: of a token its first limit + 1 symbols (any
    symbol of the result is among those of its own token), and of a word, and of a search, its first tokens that have (limit + 1) x m of
    these rows, where m is the most tokens that a symbol has: so many rows are of limit + 1 symbols at least, and all of them come before
    those of a later token.  So a token that half of the symbols have, or a word that is one letter, stays small: a search meets no more
    than (limit + 1) x (m + 1) rows.  A search without hits has no rows."""
    rows = index.select("token", "symbol_key").distinct()
    most = rows.groupBy("symbol_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("m")).first()["m"]

    def enough(df: DataFrame, key: str, *order: str) -> DataFrame:
        """The tokens of each key up to the one at which its rows are enough."""
        before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_before") < (limit + 1) * most).drop("_before")

    counts = rows.where("token IS NOT NULL").groupBy("token").agg(F.least(F.count("*"), F.lit(limit + 1)).alias("_rows"))
    pairs = enough(prefix_pairs(searches, counts, head).join(counts, "token"), "word", "token")
    asked = searches.join(pairs, "word").groupBy("search", "token").agg(F.min("word_ord").cast("long").alias("word_ord"), F.max("_rows").alias("_rows"))
    asked = enough(asked, "search", "word_ord", "token").drop("_rows")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("token").orderBy("symbol_key"))).where(F.col("_n") <= limit + 1).drop("_n")
    found = asked.join(first, "token").groupBy("search", "symbol_key").agg(F.min(F.struct("word_ord", "token")).alias("b"))
    listed = found.withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy("b.word_ord", "b.token", "symbol_key"))).where(F.col("place") <= limit + 1)
    whole = listed.withColumn("is_complete", F.max("place").over(Window.partitionBy("search")) <= limit).where(F.col("place") <= limit)
    return whole.select("search", "symbol_key", F.col("b.word_ord").alias("word_ord"), F.col("b.token").alias("token"), F.col("place").cast("long").alias("place"), "is_complete")


def path_prefixes(uri: Column) -> Column:
    """The uri up to each of its separators, them included, and the whole uri."""
    parts = F.split(uri, "/", -1)
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), "/").otherwise(""))), F.array(uri)))


def route_many(df: DataFrame, uri: str, roots: DataFrame) -> DataFrame:
    """Adds ``root``: of the roots (root, ord) that a uri lies in, the first by ord (null: none); roots end with a separator or are whole uris.

    Each uri is taken apart into its path prefixes, which meet the roots by equality, so thousands of roots cost no more than one."""
    spread = df.select(F.col(uri).alias("_uri")).where("_uri IS NOT NULL").distinct().select("_uri", F.explode(path_prefixes(F.col("_uri"))).alias("root"))
    first = spread.join(roots.select("root", "ord"), "root").groupBy("_uri").agg(F.min(F.struct("ord", "root")).alias("_r"))
    return df.join(first.select("_uri", F.col("_r.root").alias("root")), F.col(uri) == F.col("_uri"), "left").drop("_uri")
