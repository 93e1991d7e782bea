"""Closure over inheritance edges, visibility rules, first-wins reductions, outlines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Seeds from which on a closure may go by doubled steps.
MANY = 1_000


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): all that a seed reaches over edges(child, parent), itself at depth 0, nearest depth of each; cycles end.

    A recursive query under Spark's limits of levels and rows; whole_closure has none."""
    spark = edges.sparkSession
    e, s = (f"v{uuid.uuid4().hex}" for _ in range(2))
    edges.select("child", "parent").createOrReplaceTempView(e)
    seeds.select("seed").distinct().createOrReplaceTempView(s)
    rows = spark.sql(
        f"""WITH RECURSIVE walk(seed, node, depth, path) AS (
        SELECT seed, seed, 0, array(seed) FROM {s}
        UNION ALL SELECT w.seed, e.parent, w.depth + 1, array_append(w.path, e.parent) FROM walk w JOIN {e} e ON w.node = e.child WHERE NOT array_contains(w.path, e.parent))
        SELECT seed, node, depth FROM walk"""
    )
    return rows.groupBy("seed", "node").agg(F.min("depth").cast("long").alias("depth"))


def closure_loop(edges: DataFrame, seeds: DataFrame, folder: str) -> DataFrame:
    """The same for any depth and width: each round joins only the new frontier and is written to a shared folder, so plans stay short."""
    spark: SparkSession = edges.sparkSession
    step = edges.where("parent IS NOT NULL").select(F.col("child").alias("node"), "parent").distinct()
    frontier, depth, paths = seeds.select("seed", F.col("seed").alias("node")).distinct(), 0, []
    schema = frontier.withColumn("depth", F.lit(0).cast("long")).schema
    kind = step.schema["node"].dataType
    if kind == schema["node"].dataType:  # else nothing joins as it stands and each round casts
        path = f"{folder}/edges-{uuid.uuid4().hex}"
        step.write.parquet(path)
        step = spark.read.schema(step.schema).parquet(path)
    while True:
        path = f"{folder}/depth-{depth}-{uuid.uuid4().hex}"
        frontier.withColumn("depth", F.lit(depth).cast("long")).write.parquet(path)
        frontier = spark.read.schema(schema).parquet(path)  # the schema is known: no job reads it from the files
        if frontier.isEmpty():
            break
        paths.append(path)
        known = spark.read.schema(schema).parquet(*paths).select("seed", "node")
        frontier = frontier.join(step, "node").select("seed", F.col("parent").cast(schema["node"].dataType).alias("node")).distinct().join(known, ["seed", "node"], "left_anti")
        depth += 1
    return spark.read.schema(schema).parquet(*paths) if paths else frontier.withColumn("depth", F.lit(0).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def most(edges: DataFrame, seeds: DataFrame) -> bool:
    """Whether distinct seeds are so many of the nodes that doubled steps of all nodes cost less than to follow each seed."""
    return (n := seeds.count()) >= MANY and n * 2 >= edges.count()


def whole_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """closure_loop in the folder that driver and executors share, or closure_of_all where the seeds are so many that its doubled steps cost less."""
    seeds = seeds.select("seed").distinct()
    if most(edges, seeds):
        return closure_of_all(edges, seeds)
    return closure_loop(edges, seeds, f"{shared_folder(edges.sparkSession)}/closure-{uuid.uuid4().hex}")


def written(df: DataFrame, folder: str) -> DataFrame:
    """The frame, written to a new folder below one that is shared, and read back."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure_of_all(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same as whole_closure by doubled steps: after n rounds all that is nearer than 2^n steps is known, so a depth of a million takes twenty.

    Each round joins what is known with the jumps of 2^n steps of all nodes, which pays where most nodes are seeds; for few seeds
    whole_closure follows only what they reach.  Nearest depths are exact, as a way of any length is a known nearest one and a jump."""
    spark: SparkSession = edges.sparkSession
    folder = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    kind = seeds.schema["seed"].dataType
    jumps = written(edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").cast(kind).alias("node"), F.col("parent").cast(kind).alias("to")).distinct(), folder)
    known = written(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth")).distinct(), folder)
    n, length = known.count(), 1
    while True:
        new = known.join(jumps, "node").select("seed", F.col("to").alias("node"), (F.col("depth") + length).alias("depth"))
        known = written(known.unionByName(new).groupBy("seed", "node").agg(F.min("depth").alias("depth")), folder)
        before, n = n, known.count()
        if n == before:
            return known
        jumps = written(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")).distinct(), folder)
        length *= 2


def nearest_of_each(edges: DataFrame, own: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """own(node, keys, order, more) with ``depth``: for each node and key the row of the nearest node that it reaches over edges(child, parent)
    and that has one, itself at depth 0; of equally near ones the first by ``order``.

    By doubled steps, of what is found and not of all that is reached: after n rounds all rows nearer than 2^n steps are known, and a round
    asks the nodes 2^n steps above for theirs.  A row once found is never replaced, as later ones are farther, so it ends when no row is new:
    a node that lacks a key which some node above has gets it no later than its parent's own is handed on.  Cycles end too."""
    folder = f"{shared_folder(edges.sparkSession)}/nearest-{uuid.uuid4().hex}"
    kind = own.schema["node"].dataType
    jumps = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").cast(kind).alias("node"), F.col("parent").cast(kind).alias("to")).distinct()
    jumps, columns, by = written(jumps, folder), [*own.columns, "depth"], ["node", *keys]
    known = written(first_wins(own.withColumn("depth", F.lit(0).cast("long")), by, ["depth", *order]).select(columns), folder)
    length = 1
    while True:
        above = known.withColumnRenamed("node", "to").withColumn("depth", F.col("depth") + length).join(jumps, "to").select(columns)
        has = known.select(*[F.col(c).alias(f"_{c}") for c in by])
        fresh = above.join(has, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_anti")
        new = written(first_wins(fresh, by, ["depth", *order]).select(columns), folder)
        if new.isEmpty():
            return known
        known = written(known.unionByName(new), folder)
        jumps = written(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")).distinct(), folder)
        length *= 2


def first_above(edges: DataFrame, own: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """own(node, keys, depth, more): for each node and key the first row by ``order`` of the node's own and those of all nodes that it reaches
    over edges(child, parent), whose steps are added to their depth.  Rows may begin at any depth, so a farther one may come first.

    By doubled steps, of first rows and not of all that is reached: after n rounds rows less than 2^n steps above are known.  It ends when a
    round brings no node a better row: then ways twice as long bring none, and so ways of any length do not.  Cycles end too."""
    folder = f"{shared_folder(edges.sparkSession)}/above-{uuid.uuid4().hex}"
    kind = own.schema["node"].dataType
    jumps = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").cast(kind).alias("node"), F.col("parent").cast(kind).alias("to")).distinct()
    jumps, columns, by, length = written(jumps, folder), own.columns, ["node", *keys], 1
    known = written(first_wins(own, by, order).select(columns), folder)
    while True:
        above = known.withColumnRenamed("node", "to").withColumn("depth", F.col("depth") + length).join(jumps, "to").select(columns)
        both = known.withColumn("_new", F.lit(0)).unionByName(above.withColumn("_new", F.lit(1)))
        better = written(first_wins(both, by, [*order, "_new"]), folder)
        if better.where("_new = 1").isEmpty():
            return known
        known = better.select(columns)
        jumps = written(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")).distinct(), folder)
        length *= 2


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in an order, from 0: rows are dealt to ranges, and the sizes of the ranges before one are added to its own places."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), folder)
    sizes = dealt.groupBy("_part").count()  # a row per partition
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_before")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node, path): for each node(node, parent, ord) the steps (ord, node) from its root, by doubled steps.

    A parent that is no node makes its child a root.  Nodes on a cycle or below one have no path and no row."""
    folder = f"{shared_folder(nodes.sparkSession)}/paths-{uuid.uuid4().hex}"
    known = nodes.select(F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    paths = nodes.join(known, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.array(F.struct("ord", "node")).alias("path"))
    while True:
        paths = written(paths, folder)
        if paths.where("up IS NOT NULL").isEmpty():
            return paths.select("node", "path")
        above = paths.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = paths.join(above, "up", "left").where("up IS NULL OR _path IS NOT NULL")  # what has gone from the table was on a cycle
        grown = joined.select("node", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast(paths.schema["path"].dataType)), "path").alias("path"))
        steps = F.transform("path", lambda s: s["node"])
        paths = grown.where((F.size(F.array_distinct(steps)) == F.size(steps)) & ~F.coalesce(F.array_contains(steps, F.col("up")), F.lit(False)))


def tree_order(nodes: DataFrame) -> DataFrame:
    """(node, depth, pre, size) of nodes(node, parent, ord): place in a walk that visits a node before its children, these by ord and node.

    size counts the node and all below it, so b lies below a exactly if a.pre < b.pre < a.pre + a.size.  Several roots are walked in order."""
    paths = tree_paths(nodes)
    sizes = paths.select(F.explode("path.node").alias("node")).groupBy("node").agg(F.count("*").alias("size"))
    placed = numbered(paths.select("node", (F.size("path") - 1).cast("long").alias("depth"), "path"), [F.col("path")], "pre")
    return placed.drop("path").join(sizes, "node").select("node", "depth", F.col("pre").cast("long").alias("pre"), "size")


def tree_walk(nodes: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, depth, place) of the nodes that a walk visits which does not go below the nodes of ``stops`` (node): these are visited themselves."""
    paths = tree_paths(nodes)
    above = paths.select(F.col("node").alias("below"), F.explode(F.slice("path.node", F.lit(1), F.size("path") - 1)).alias("node"))
    hidden = above.join(stops.select("node").distinct(), "node", "left_semi").select(F.col("below").alias("node")).distinct()
    seen = paths.join(hidden, "node", "left_anti")
    return numbered(seen.select("node", (F.size("path") - 1).cast("long").alias("depth"), "path"), [F.col("path")], "place").select("node", "depth", F.col("place").cast("long").alias("place"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row in order, by an aggregate (partial sums keep hot keys small)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def instance_access(visibility: Column, owner: Column, current: Column, scope_is_current: Column, via_this: Column, related: Column | None = None) -> Column:
    """Members that an instance access may see: by $this all but strangers' private ones; public ones; all within the class; protected ones of relatives."""
    same = owner == current
    rule = (via_this & (same | (visibility != 2))) | (visibility == 0) | scope_is_current
    return rule if related is None else rule | (related & (visibility == 1))


def static_access(visibility: Column, static: Column, owner: Column, current: Column, how: Column, scope_is_owner: Column, related: Column | None = None) -> Column:
    """how: parent, relative (self, static, $this) or name."""
    named = (visibility == 0) | scope_is_owner
    named = named if related is None else named | (related & (visibility == 1))
    return F.when(how == "parent", (owner != current) & (visibility != 2)).when(how == "relative", (owner == current) | (visibility != 2)).otherwise(static & named)


def nearest_kept(nodes: DataFrame, edges: DataFrame, kept: Column) -> DataFrame:
    """(node, parent, depth): kept nodes under their nearest kept ancestor (null: none); the others are spliced out."""
    keep = nodes.where(kept).select("node")
    up = closure_of_all(edges, keep.withColumnRenamed("node", "seed")).where("depth > 0")
    above = up.join(keep, "node", "left_semi").groupBy("seed").agg(F.min_by("node", "depth").alias("parent"), F.count("*").alias("depth"))
    return keep.join(above.withColumnRenamed("seed", "node"), "node", "left").select("node", "parent", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
