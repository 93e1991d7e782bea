"""Document fingerprints by spot signatures, native columns only.

A spot is a common word (anchor) directly before a content word; its chain is that content word and the next one, common
words between them skipped (the last content word stands alone).  The hashes of (anchor, chain) form a document's signature set.  A document without any spot
takes its words one by one instead, so texts in languages without listed anchors still get a set.  Sets are
compared by Jaccard similarity; the ratio of the set sizes bounds it, so pairs below a threshold are pruned by length
before any hash is compared, and the pair join partitions sets by length.

A document's own set is made before the texts are dealt out in order and travels with its text, so each set is made once.

Defined cases: a null text is empty; an empty set has an empty fingerprint, likeness 1 to another empty set and 0 to any
other; a very long text is read whole; documents are ordered by doc_id (null first), then a hash of the text, equal rows next to
each other; the next of the last is the first (itself, if alone); an empty table gives no rows;
extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, words

#: Common words that anchor spots (English, German, French, Spanish).
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it not of on or said she that the their there they this to was were which will with you "
    "auf das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von wie zu "
    "au aux avec ce dans de des du elle en est et il la le les pas par pour que qui sur un une "
    "al con del el ella en es las lo los más no para pero por se su una y"
).split()
#: Documents per block of the order by doc_id, at least (there are no more blocks than the session has shuffle partitions, and
#: as many again for ids with many rows; a block's sort can spill); equal rows that one task writes out at most.
BLOCK, CHUNK = 2_000, 1_000
#: Blocks that one doc_id may be cut to.
SUBS = 1 << 20


def signature_set(text: Column) -> Column:
    """Sorted distinct 32-bit signatures of a text."""

    def spots(w: Column) -> Column:
        # content words, those right after an anchor as "anchor word"
        marked = F.filter(
            F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), F.lit(None)).when((i > 0) & F.get(w, i - 1).isin(ANCHORS), F.concat(F.get(w, i - 1), F.lit(" "), x)).otherwise(x)),
            lambda x: x.isNotNull(),
        )
        chains = let(marked, lambda c: F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.when(F.contains(a, F.lit(" ")), F.hash(a, F.substring_index(b, " ", -1)))))
        found = F.array_compact(chains)
        return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.transform(w, lambda x: F.hash(x))))

    return F.array_sort(F.array_distinct(let(words(text), spots)))


def fingerprint(signatures: Column) -> Column:
    """The set as text: its size, then the signatures in base 16."""
    return F.when(F.size(signatures) == 0, F.lit("")).otherwise(F.concat(F.size(signatures).cast("string"), F.lit(":"), F.array_join(F.transform(signatures, lambda s: F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), ",")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where the sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).when(small < large * F.lit(least), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, block: int = BLOCK, carry=None) -> DataFrame:
    """doc_id, text (null: empty), next_text, the text of the next document in order, and with ``carry`` (a function of the
    text's column) also own and next_own, what it gives for both texts.

    Different rows are ordered by doc_id and a hash of the text.  Blocks are cut at quantiles of the ids, and an id with more rows than
    two blocks is cut by hash; each block also gets a ghost of the next block's first row, so one shuffle deals the texts out
    and no task sees more than a block.  Equal rows follow each other, so only the last one's next is another text: they are
    brought to one before they move and written out again after."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("th", F.xxhash64("text"))
    per = cut(own.groupBy("doc_id", "th").agg(F.count("*").alias("c")), "ids")
    n = per.count()
    m = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-n // block)))
    size = -(-n // m) if n else 1
    cuts = sorted({x for x in (per.agg(F.percentile_approx("doc_id", [i / m for i in range(1, m)], 10 * m)).first()[0] or [])}) if m > 1 else []
    # ids that fill blocks of their own: fewer than blocks, so they are broadcast
    hot = per.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size).select(F.col("doc_id").alias("_hot"), F.ceil(F.col("n") / size).alias("_subs"), F.lit(True).alias("_is_hot"))
    hot = F.broadcast(cut(hot, "hot"))
    least = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "th")

    def numbered(rows: DataFrame) -> DataFrame:
        """Adds b, the number of a row's block: nulls first; rows of a hot id by hash before the other ids of its block."""
        base = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + _bucket(F.col("doc_id"), cuts)).cast("long") * SUBS
        share = F.floor((F.col("th").cast("double") / F.lit(2.0**64) + 0.5) * F.least(F.lit(SUBS - 2), F.col("_subs")))
        return rows.join(hot, F.col("doc_id").eqNullSafe(F.col("_hot")), "left").withColumn("b", base + F.when(F.col("_is_hot"), share).otherwise(F.lit(SUBS - 1))).drop("_hot", "_subs", "_is_hot")

    firsts = numbered(per).groupBy("b").agg(F.min(least).alias("f"))
    in_order = Window.orderBy("b")  # a row per block
    ends = F.coalesce(F.lag("b").over(in_order), F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ghosts = firsts.withColumn("to", ends).select(F.col("f.doc_id").alias("_id"), F.col("f.th").alias("_th"), F.col("b").alias("_b"), "to")
    ghosts = F.broadcast(cut(ghosts, "ghosts"))
    kept = ["text"] if carry is None else ["text", "own"]
    again = per.where("c > 1")
    few = again.count()
    single = own.withColumn("c", F.lit(1).cast("long"))
    if few:
        some = again.select(F.col("doc_id").alias("k"), F.col("th").alias("t"), "c")
        some = F.broadcast(some) if few <= 500_000 else some
        same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))
        single = own.join(some, same, "left_anti").withColumn("c", F.lit(1).cast("long")).unionByName(own.join(some, same).groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("c").alias("c")))
    rows = numbered(single.select("doc_id", "text", "th", "c", *([] if carry is None else [carry(F.col("text")).alias("own")])))
    # the first row of a block also goes to the block that ends before it
    met = rows.join(ghosts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("b") == F.col("_b")), "left")
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))
    places = F.when(F.col("to").isNotNull(), F.array(here, F.struct(F.col("to").alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(here))
    dealt = met.select("doc_id", "th", "c", *kept, places.alias("at")).select("doc_id", "th", "c", *kept, F.inline("at"))
    w = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "th")
    last = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in kept}).where("ghost = 0").select("doc_id", *kept, *[f"next_{c}" for c in kept])
    if not few:
        return last
    more = rows.where("c > 1").select("doc_id", "th", *kept, (F.col("c") - 1).alias("c")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / CHUNK)))).repartition("doc_id", "th", "chunk")
    more = more.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("c") - F.col("chunk") * CHUNK).cast("int"))))
    return last.unionByName(more.select("doc_id", *kept, *[F.col(c).alias(f"next_{c}") for c in kept]))


def _bucket(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most x: first among every so manieth, then in the part between two of these."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    at_most = lambda c: F.size(F.filter(c, lambda v: v <= x))
    coarse = at_most(F.lit(cuts[step - 1 :: step])) * step
    return let(coarse, lambda k: k + at_most(F.slice(F.lit(cuts), k + 1, F.lit(step))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited."""
    rows = with_next(docs, carry=signature_set)
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("own").alias("s"), signature_set(edited).alias("e"), F.col("next_own").alias("x"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"), "edited",
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness >= least) between different fingerprints, and membership (doc_id, class_id: smallest doc_id of its fingerprint).

    Sets fall into length partitions whose bounds grow by 1/least, so partners are in the same or the next one; the join
    goes by the rarest signatures that any partner must share (prefix filter), each pair is checked once, exactly."""
    member = docs.select("doc_id", signature_set(F.col("text")).alias("s")).withColumn("class_id", F.min("doc_id").over(Window.partitionBy(F.xxhash64("s"))))
    member = cut(member, "spots")
    sets = member.where("doc_id = class_id and size(s) > 0").dropDuplicates(["class_id"]).select("class_id", "s", F.floor(F.log(F.size("s").cast("double")) / F.lit(-_ln(least))).cast("int").alias("part"))
    df = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sets.select("class_id", "part", F.size("s").alias("n"), F.explode("s").alias("sig")).join(df, "sig").where("df > 1").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.col("df"), F.col("sig"))))
    # signatures that stand in one set only come first in the order by rarity and match nothing
    singles = sets.select("class_id", F.size("s").alias("n")).join(ranked.groupBy("class_id").agg(F.count("*").alias("m")), "class_id").select("class_id", (F.col("n") - F.col("m")).alias("single"))
    prefix = ranked.join(singles, "class_id").where(F.col("r") + F.col("single") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("class_id", "part", "n", "sig")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    found = left.join(right, ["sig", "part"]).where("(na < nb or (na = nb and a < b)) and na >= nb * %r" % least).select("a", "b").distinct()
    both = found.join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    pairs = both.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, member.select("doc_id", "class_id")


def _ln(x: float) -> float:
    import math

    return math.log(x)
