"""Mixing sources to target weights: weighted pivotal rounding along a reduction tree, native columns only.

A source's target over its size is the number of copies each of its documents is due; whole copies are given at once
and the fractions are rounded in pairs.  Two documents exchange mass so that the sum of size times fraction stays the
same, until one fraction is 0 or 1; which way is drawn with the odds that keep every document's expectation.  A block of
documents is folded this way, long ones first, to one residual, and the residuals of the blocks are folded again, level by level, to one
residual per source.  In the last fold, of at most BLOCK residuals, a residual twice as long as the next document is rounded
alone and what that misses is owed to the shorter documents that follow (plain pairs would leave a small source off by a long
document), so a source misses its target by about a short document; expectations are kept exactly but for those few.

Equal rows are one item, due as many times the copies, whose copies are dealt evenly over its rows; so no window and no join
holds more rows of one document than an input partition does.

Draws are hashes of (seed, document), so reruns agree.  Defined cases: a null or empty text has size 0, is taken 0 words and gets the whole copies due alone; a very
long text is counted whole; a null source is a source of its own, last in order; of documents of the same size the smaller
key is folded first; a null doc_id is no other document's; repeated rows are separate documents; an empty table gives no rows;
extra columns, also of the names used here, are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, unsigned

#: Documents folded in one block; the tree has log_BLOCK(rows) levels.
BLOCK = 512
SPACE_RUN = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_RUN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, n_docs, source_size, target): targets proportional to the weights, held at ``most`` times a source's size.

    Held sources are a prefix in the order of most*size/weight, so running sums find the level without a loop."""
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ladder = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here = ladder.rowsBetween(Window.unboundedPreceding, -1), ladder.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    numbered = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    steps = numbered.withColumn("room", F.lit(most) * F.col("source_size")).select(
        "*", F.sum("source_size").over(every).alias("total"), F.coalesce(F.sum("room").over(before), F.lit(0)).alias("held"), F.sum("weight").over(from_here).alias("open")
    )
    level = (F.col("total") - F.col("held")).cast("double") / F.col("open")
    free = steps.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("room"))
    # the first source that fits sets the level for all after it
    chosen = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("room") / F.col("weight"))).over(every)
    return free.withColumn("level", chosen).select(
        "source", "n_docs", "source_size", F.least(F.col("room").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("room").cast("double"))).alias("target")
    )


ITEM = "struct<key:string,size:bigint,p:double>"
DONE = "array<struct<key:string,up:int>>"


def _item(d: Column, p: Column | None = None) -> Column:
    return F.struct(d["key"].alias("key"), d["size"].alias("size"), (d["p"] if p is None else p).alias("p"))


def _settled(d: Column, up: Column) -> Column:
    return F.struct(d["key"].alias("key"), up.cast("int").alias("up"))


def _state(done: Column, rest: Column, owed: Column) -> Column:
    return F.struct(done.cast(DONE).alias("done"), rest.cast(ITEM).alias("rest"), owed.cast("double").alias("owed"))


def _alone(d: Column, seed: int) -> Column:
    return (unsigned(F.xxhash64(F.lit(seed), d["key"])) < d["p"]).cast("int")


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """The residual and the next document exchange mass until one of them is settled."""
    a, one, zero = acc["rest"], F.lit(1.0), F.lit(0.0)
    wa, wx, room_a, room_x = a["size"] * a["p"], x["size"] * x["p"], a["size"] * (one - a["p"]), x["size"] * (one - x["p"])
    up, down = F.least(room_a, wx), F.least(wa, room_x)
    gain = unsigned(F.xxhash64(F.lit(seed), a["key"], x["key"])) * (up + down) < down
    a_full, a_none, x_none = gain & (room_a <= wx), ~gain & (wa <= room_x), gain & (room_a > wx)
    moved = F.when(gain, up).otherwise(-down)
    held = lambda w, size: F.greatest(zero, F.least(one, w / size))
    out = F.when(a_full, _settled(a, F.lit(1))).when(x_none, _settled(x, F.lit(0))).when(a_none, _settled(a, F.lit(0))).otherwise(_settled(x, F.lit(1)))
    rest = F.when(a_full | a_none, _item(x, held(wx - moved, x["size"]))).otherwise(_item(a, held(wa + moved, a["size"])))
    return F.when(a.isNull(), _state(acc["done"], _item(x), acc["owed"])).otherwise(_state(F.concat(acc["done"], F.array(out)), rest, acc["owed"]))


def _last_pair(acc: Column, x: Column, seed: int) -> Column:
    """As _pair; but a residual twice as long as the next document is settled alone and what that misses is owed to the shorter ones."""
    a = acc["rest"]
    alone = a.isNotNull() & (x["size"] * 2 <= a["size"])
    up = _alone(a, seed)
    freed = F.when(alone, _state(F.concat(acc["done"], F.array(_settled(a, up))), F.lit(None), acc["owed"] + a["size"] * (a["p"] - up))).otherwise(acc)

    def owed(acc: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] + acc["owed"] / x["size"]))
        return let(p, lambda p: pay(acc, p))

    def pay(acc: Column, p: Column) -> Column:
        left = acc["owed"] - (p - x["p"]) * x["size"]
        whole = (p <= 0) | (p >= 1)
        return let(
            F.struct(_state(acc["done"], acc["rest"], left).alias("acc"), _item(x, p).alias("x"), whole.alias("whole")),
            lambda s: F.when(s["whole"], _state(F.concat(s["acc"]["done"], F.array(_settled(s["x"], s["x"]["p"]))), s["acc"]["rest"], s["acc"]["owed"])).otherwise(_pair(s["acc"], s["x"], seed)),
        )

    return let(freed, owed)


#: Documents folded between two growths of a block's list of settled ones, so a block costs little more than its length.
RUN = 16


def _fold(docs: Column, last: bool, seed: int) -> Column:
    """Folds array<struct(key, size, p)> to struct(done array<struct(key, up)>, rest struct(key, size, p))."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(docs) - 1) / RUN).cast("int")), lambda r: F.slice(docs, r * RUN + 1, F.lit(RUN)))
    step = _last_pair if last else _pair

    def run(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, _state(F.array(), acc["rest"], acc["owed"]), lambda a, x: step(a, x, seed))
        return let(inner, lambda i: _state(F.concat(acc["done"], i["done"]), i["rest"], i["owed"]))

    folded = F.aggregate(runs, _state(F.array(), F.lit(None), F.lit(0.0)), run)
    if not last:
        return folded
    return let(folded, lambda f: F.when(f["rest"].isNull(), f).otherwise(_state(F.concat(f["done"], F.array(_settled(f["rest"], _alone(f["rest"], seed)))), F.lit(None), f["owed"])))


def _name(doc_id: Column) -> Column:
    """A document's id as text; that of a null id is no other's."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null"))


def _key(docs: DataFrame, like: list[str]) -> Column:
    """The name of all rows that are equal in some columns."""
    return F.concat_ws(":", _name(F.col("doc_id")), F.hex(F.xxhash64(*like)))


def _shares(sized: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """From rows (key, salt, source, size): (key, m, total): the copies that the m equal rows of a key take together; and the sources."""
    targets = cut(source_targets(sized, weights, most), "targets")
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    # one row per source: small as long as sources are, which is checked
    side = targets.withColumnRenamed("source", "s")
    side = F.broadcast(side) if targets.count() <= 100_000 else side
    items = sized.groupBy("key").agg(F.count("*").alias("m"), F.first("source").alias("source"), F.first("size").alias("size"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = F.col("m") * F.when(F.col("size") > 0, each).otherwise(F.floor(each))
    items = items.join(side, items["source"].eqNullSafe(side["s"])).drop("s").withColumn("due", due)
    items = cut(items.select("key", "m", "source", "n_docs", "size", F.floor("due").alias("whole"), (F.col("due") - F.floor("due")).alias("p")), "items")
    open_rows = items.where("p > 0").select("source", "n_docs", F.struct((-F.col("size")).alias("order"), "key", "size", "p").alias("d"))
    settled, level, width = [], 0, most_docs
    while True:
        last = width <= BLOCK
        blocks = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(BLOCK // 2) * (BLOCK // 2) ** level)))
        block = F.pmod(F.xxhash64(F.lit(seed + level), F.col("d.key")), blocks)
        grouped = open_rows.groupBy("source", block.alias("block")).agg(F.first("n_docs").alias("n_docs"), F.array_sort(F.collect_list("d")).alias("ds"))
        folded = cut(grouped.select("source", "n_docs", _fold(F.col("ds"), last, seed + 1000 + level).alias("f")), f"fold{level}")
        settled.append(folded.select(F.inline("f.done")))
        if last:
            break
        open_rows = folded.where(F.col("f.rest").isNotNull()).select("source", "n_docs", F.struct((-F.col("f.rest.size")).alias("order"), "f.rest.key", "f.rest.size", "f.rest.p").alias("d"))
        width, level = -(-width // (BLOCK // 2)), level + 1
    ups = settled[0]
    for s in settled[1:]:
        ups = ups.unionByName(s)
    return items.join(ups, "key", "left").select("key", "m", (F.col("whole") + F.coalesce("up", F.lit(0))).alias("total")), side


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, copies, taken."""
    key = _key(docs, ["doc_id", "text", "source"])
    sized = cut(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key"), F.spark_partition_id().alias("salt")), "sized")
    shares, side = _shares(sized, weights, most, seed)
    # equal rows are numbered by input partition: the rows of a partition follow those of the partitions before
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = sized.groupBy("key", "salt").agg(F.count("*").alias("c")).join(shares, "key").withColumn("begin", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    rows = sized.join(begins, ["key", "salt"]).withColumn("i", F.col("begin") + F.row_number().over(Window.partitionBy("key", "salt").orderBy("size")))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("i") <= F.col("total") % F.col("m")).cast("int")
    rows = rows.select("doc_id", "source", "size", copies.cast("long").alias("copies"))
    return rows.join(side, rows["source"].eqNullSafe(side["s"])).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Copies of one document that are written out by one task at most.
CHUNK = 1_000


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The documents, with all their columns, each repeated as often as the mix takes it (not at all: gone)."""
    own, key = F.struct(*[F.col(c) for c in docs.columns]), _key(docs, ["doc_id", "text", "source"])
    sized = cut(docs.select("source", text_size(F.col("text")).alias("size"), key.alias("key"), F.lit(0).alias("salt")), "sized")
    shares = cut(_shares(sized, weights, most, seed)[0].where("total > 0").withColumnRenamed("key", "k"), "shares")
    rows = docs.select(own.alias("row"), key.alias("key"), F.xxhash64(*docs.columns).alias("like"))
    taken = rows.join(shares.where("m = 1"), F.col("key") == F.col("k")).select("row", "total")
    many = shares.where("m > 1")
    few = many.count()
    if few:
        # equal rows are brought to one with their number before they move, and their copies are dealt out in chunks
        some = F.broadcast(many) if few <= 500_000 else many
        one = rows.join(some, F.col("key") == F.col("k")).groupBy("key", "m", "total", "like").agg(F.first("row").alias("row"), F.count("*").alias("c"))
        begin = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("like").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = F.greatest(F.lit(0), F.least(F.col("begin") + F.col("c"), F.col("total") % F.col("m")) - F.col("begin"))
        one = one.withColumn("begin", begin).select("row", (F.col("c") * F.floor(F.col("total") / F.col("m")) + more).alias("total")).where("total > 0")
        chunks = one.select("row", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / CHUNK))).alias("chunk"))
        dealt = chunks.repartition(F.col("row.doc_id"), F.col("chunk"))
        taken = taken.unionByName(dealt.select("row", F.least(F.lit(CHUNK), F.col("total") - F.col("chunk") * CHUNK).alias("total")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("total").cast("int")))).select("row.*")
