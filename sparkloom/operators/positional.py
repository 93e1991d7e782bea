"""Lines and offsets, as-of lookups, interval stabbing, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lines whose offsets are summed in one run; longer texts sum the runs first, so no array is grown line by line.
RUN = 256
BREAK = r"\r\n|\n|\r"


def _before(lengths: Column) -> Column:
    """Of each length the sum of those before it."""
    grown = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.slice(grown, F.lit(1), F.size(lengths))


def line_starts(text: Column, length=F.length) -> Column:
    """Offsets (from 0, characters unless ``length`` measures otherwise) at which lines begin; LF, CRLF and CR end a line."""
    lines, ends = F.split(text, BREAK, -1), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
    lengths = F.zip_with(lines, ends, lambda a, b: (length(a) + F.coalesce(length(b), F.lit(0))).cast("long"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / RUN).cast("int")), lambda r: F.slice(lengths, r * RUN + 1, F.lit(RUN)))

    def placed(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, n: a + n))
        return F.flatten(F.zip_with(runs, _before(sums), lambda r, first: F.transform(_before(r), lambda x: x + first)))

    return F.get(F.transform(F.array(runs), placed), F.lit(0))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, length): the starts are an array of the document, so nothing is shuffled."""
    per = docs.select(key, line_starts(F.col(text)).alias("s"), F.transform(F.split(F.col(text), BREAK, -1), F.length).alias("n"))
    rows = per.select(key, F.posexplode(F.arrays_zip("s", "n")).alias("line", "z"))
    return rows.select(key, F.col("line").cast("long").alias("line"), F.col("z.s").alias("start"), F.col("z.n").cast("long").alias("length"))


def line_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, byte_start, byte_length): the line table in bytes of UTF-8."""
    per = docs.select(key, line_starts(F.col(text), F.octet_length).alias("s"), F.transform(F.split(F.col(text), BREAK, -1), F.octet_length).alias("n"))
    rows = per.select(key, F.posexplode(F.arrays_zip("s", "n")).alias("line", "z"))
    return rows.select(key, F.col("line").cast("long").alias("line"), F.col("z.s").alias("byte_start"), F.col("z.n").cast("long").alias("byte_length"))


def byte_offset(text: Column, offset: Column) -> Column:
    """The byte at which a character stands."""
    return F.octet_length(F.substring(text, F.lit(1), offset.cast("int"))).cast("long")


def position_offset(text: Column, line: Column, character: Column) -> Column:
    """Offset (characters) of a position: the start of its line and the characters in it, at most the text's end.

    The text is cut at its line's break only, and no line table is made."""
    ended = F.regexp_replace(text, BREAK, "\n")  # breaks of one character, each where its last stood
    before = F.call_function("substring_index", ended, F.lit("\n"), line.cast("int"))
    extra = F.regexp_count(text, F.lit(r"\r\n"))  # a break of two characters anywhere: the exact way
    plain = F.length(before) + F.when(line > 0, 1).otherwise(0)
    start = F.when(extra == 0, plain).otherwise(F.get(line_starts(text), line.cast("int")))
    return F.when(line > F.regexp_count(ended, F.lit("\n")), F.length(text)).otherwise(F.least(start + character, F.length(text))).cast("long")


def offset_line(text: Column, offset: Column) -> Column:
    """Line of an offset: breaks before it, without any join."""
    return F.regexp_count(F.substring(text, F.lit(1), offset.cast("int")), F.lit(BREAK)).cast("long")


def as_of(versions: DataFrame, probes: DataFrame, key: str, at: str, value: Column, inclusive: bool = True, tie: str | None = None) -> DataFrame:
    """Probes with the last version of their key at or before (strict: before) their position.

    One shuffle by key and one sort: versions and probes run together through a window, probes after equal versions
    (inclusive) or before them (strict); no inequality join."""
    extra = [c for c in probes.columns if c not in (key, at)]
    v = versions.select(key, at, value.alias("_v"), F.lit(0 if inclusive else 1).alias("_o"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_t"), F.lit(False).alias("_probe"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    p = probes.select(key, at, F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.lit(1 if inclusive else 0).alias("_o"), F.lit(0).cast("long").alias("_t"), F.lit(True).alias("_probe"), *extra)
    w = Window.partitionBy(key).orderBy(at, "_o", "_t").rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(p).withColumn("found", F.last("_v", ignorenulls=True).over(w)).where("_probe").select(key, at, *extra, "found")


def stab(ranges: DataFrame, points: DataFrame, start: str, end: str, at: str, keys: list[str] = ()) -> DataFrame:
    """Pairs of ranges and points inside [start, end): an equality join on cells of the ranges' own sizes, then checked.

    start, end and at are whole numbers.  A range lies in the cells of the least power of two that is as long, of which it meets two at
    most; a point is looked for in its cell of each size that some range has, 64 at most and as a rule few.  Empty ranges hold nothing."""
    length = F.col(end) - F.col(start)
    sized = ranges.where(length > 0).withColumn("_size", F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int"))
    cell = lambda x, size: F.call_function("shiftright", x.cast("long"), size)
    r = sized.withColumn("_cell", F.explode(F.sequence(cell(F.col(start), F.col("_size")), cell(F.col(end) - 1, F.col("_size")))))
    sizes = sorted(x["_size"] for x in sized.select("_size").distinct().collect())
    p = points.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"))).withColumn("_cell", cell(F.col(at), F.col("_size")))
    return p.join(r, [*keys, "_size", "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_size", "_cell")


def deepest(pairs: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Of each point the value of the last range in order."""
    return pairs.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("found"), F.count("*").alias("n_ranges"))


def active_parameter(ends: Column, at: Column) -> Column:
    """Number of ranges that end at or before a position."""
    return F.size(F.filter(ends, lambda e: e <= at)).cast("long")


def ordered_versions(versions: DataFrame, key: str, start: str, seq: str, value: Column) -> DataFrame:
    """(key, versions): of each key an array by start; equal starts stay in the order they came."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(start).alias("start"), F.col(seq).alias("seq"), value.alias("value"))))
    return versions.groupBy(key).agg(F.transform(listed, lambda v: F.struct(v["start"].alias("start"), v["value"].alias("value"))).alias("versions"))


def as_of_or_first(blocks: DataFrame, probes: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """Probes with the last block of their key that starts before them; where none does, its first."""
    first = blocks.groupBy(key).agg(F.min_by(value, at).alias("_first"))
    return as_of(blocks, probes, key, at, value, inclusive=False).join(first, key, "left").withColumn("found", F.coalesce("found", "_first")).drop("_first")


def before(nodes: DataFrame, points: DataFrame, key: str, start: str, at: str, value: Column) -> DataFrame:
    """Points with the last node (in order of start) that starts before them or holds them."""
    return as_of(nodes.withColumnRenamed(start, at), points, key, at, value, inclusive=True)


def owner_of(ranges: DataFrame, points: DataFrame, key: str, end: str, order: str, at: str, value: Column) -> DataFrame:
    """Points with the first range (in order) that does not end before them; it may begin after them.

    Ranges are ordered by their ends too, so the first with an end beyond the point is the as-of lookup run from the back."""
    r = ranges.select(key, (-F.col(end)).alias(at), F.struct(F.col(order).alias("o"), value.alias("v")).alias("_x"))
    p = points.withColumn("_at", F.col(at)).withColumn(at, -F.col(at))
    found = as_of(r, p, key, at, F.col("_x"), inclusive=False)
    return found.withColumn(at, F.col("_at")).withColumn("found", F.col("found.v")).drop("_at")


def spine(ranges: DataFrame, points: DataFrame, start: str, end: str, at: str, keys: list[str], value: Column) -> DataFrame:
    """Points with all ranges whose (start, end] holds them, outermost first."""
    shifted = points.withColumn("_p", F.col(at)).withColumn(at, F.col(at) - 1)
    held = stab(ranges, shifted, start, end, at, keys)
    chain = F.transform(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e"), value.alias("v")))), lambda x: x["v"])
    return held.groupBy(*keys, F.col("_p").alias(at)).agg(chain.alias("spine"))
