"""Name and type-string algebra as pure column functions (a name is `\\Ns\\Sub\\Short`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BS = "\\"
#: Names that never take a namespace, and spelling aliases.
NATIVES = tuple("mixed null bool true false int float real double string binary array object callable void static $this __DIR__ __FILE__".split())
#: Names of the scope of the access itself, and of its parent.
RELATIVE, PARENT = ("static", "self", "$this"), ("parent",)
ALIASES = {"boolean": "bool", "integer": "int"}
VISIBILITY = ("public", "protected", "private")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, BS, -1)


def scope_of(name: Column) -> Column:
    """Scope part: '' and 'A' have scope `\\` and ''; `\\A` has `\\`; `N\\A` and `\\N\\A` have `\\N`."""
    head = F.substring(name, F.lit(1), F.length(name) - F.length(last_segment(name)) - 1)
    lead = F.when(head.startswith(BS), head).otherwise(F.concat(F.lit(BS), head))
    return F.when(name == "", F.lit(BS)).when(~F.contains(name, F.lit(BS)), F.lit("")).when(head == "", F.lit(BS)).otherwise(lead)


def namespace_of(fqn: Column) -> Column:
    """Text before the last backslash; none or a leading one only gives `\\`."""
    head = F.substring(fqn, F.lit(1), F.greatest(F.length(fqn) - F.length(last_segment(fqn)) - 1, F.lit(0)))
    return F.when(head == "", F.lit(BS)).otherwise(head)


def is_relative(name: Column) -> Column:
    return name.isin(*RELATIVE)


def is_parent(name: Column) -> Column:
    return name.isin(*PARENT)


def is_empty_type(t: Column) -> Column:
    return t["fqn"].isin("", BS)


def is_empty_types(types: Column) -> Column:
    """A type set without any named type."""
    return ~F.exists(types, lambda t: ~is_empty_type(t))


def is_qualified(name: Column) -> Column:
    return name.startswith(BS) | name.isin(*NATIVES)


def qualify(name: Column, namespace: Column) -> Column:
    """Natives and names with a leading backslash stay; others go under the namespace."""
    ns = F.when(namespace.isin("", BS), F.lit("")).when(namespace.startswith(BS), namespace).otherwise(F.concat(F.lit(BS), namespace))
    return F.when(is_qualified(name), name).otherwise(F.concat(ns, F.lit(BS), name))


def parts(name: Column) -> Column:
    """Segments without the empty one that a leading backslash makes."""
    return F.filter(F.split(name, r"\\"), lambda p: p != "")


def first_part(name: Column) -> Column:
    return F.get(parts(name), F.lit(0))


def lookup_key(fqn: Column) -> Column:
    """Only the last segment in lower case."""
    short = last_segment(fqn)
    return F.concat(F.substring(fqn, F.lit(1), F.length(fqn) - F.length(short)), F.lower(short))


def type_struct(text: Column) -> Column:
    """struct(fqn, array_level) of a type text: trailing [] pairs are counted, aliases replaced."""
    base = F.regexp_extract(text, r"^(.*?)((\[\])*)$", 1)
    level = (F.length(F.regexp_extract(text, r"^(.*?)((\[\])*)$", 2)) / 2).cast("long")
    for alias, name in ALIASES.items():
        base = F.when(base == alias, F.lit(name)).otherwise(base)
    return F.struct(base.alias("fqn"), level.alias("array_level"))


def type_text(t: Column) -> Column:
    return F.concat(t["fqn"], F.repeat(F.lit("[]"), t["array_level"].cast("int")))


def element_type(types: Column) -> Column:
    """Types of the elements: one array level less; plain types drop out."""
    return F.transform(F.filter(types, lambda t: t["array_level"] > 0), lambda t: F.struct(t["fqn"].alias("fqn"), (t["array_level"] - 1).alias("array_level")))


def type_union(types: Column) -> Column:
    """First of each fqn, in order (the array level is not compared)."""
    return F.aggregate(types, F.slice(types, 1, 0), lambda acc, t: F.when(F.exists(acc, lambda a: a["fqn"] == t["fqn"]), acc).otherwise(F.concat(acc, F.array(t))))


def shift_union(types: Column, more: Column, levels: Column | int) -> Column:
    """The union after ``levels`` were added to the array level of each type of ``more``."""
    up = F.transform(more, lambda t: F.struct(t["fqn"].alias("fqn"), (t["array_level"] + levels).cast("long").alias("array_level")))
    return type_union(F.concat(types, up))


def types_text(types: Column) -> Column:
    return F.array_join(F.transform(F.filter(types, lambda t: ~t["fqn"].isin("", BS)), type_text), "|")


def position(line: Column, character: Column) -> Column:
    """Structs of this kind compare as positions do."""
    return F.struct(line.cast("int").alias("line"), character.cast("int").alias("character"))


def position_text(p: Column) -> Column:
    return F.concat_ws(":", p["line"].cast("string"), p["character"].cast("string"))


def compare_range(p: Column, start: Column, end: Column) -> Column:
    """-1 before, 0 in [start, end), 1 at or after the end."""
    return F.when(p < start, F.lit(-1)).when(p < end, F.lit(0)).otherwise(F.lit(1))


def word_before(text: Column) -> Column:
    """The identifier (with backslashes) that a text ends in."""
    return F.regexp_extract(text, r"[\\a-zA-Z0-9_\x{80}-\x{10FFFF}]*\z", 0)


def visibility_text(v: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in VISIBILITY]), (v + 1).cast("int"))


def member_label(visibility: Column, static: Column, name: Column) -> Column:
    return F.concat_ws(" ", visibility_text(visibility), F.when(static, F.lit("static")), name)


def canonical_uri(uri: Column, root: str) -> Column:
    return F.when(uri.startswith(root), F.substring(uri, F.lit(len(root) + 1), F.length(uri))).otherwise(uri)


def path_to_uri(path: Column) -> Column:
    """file:// URI with each segment percent-encoded; a drive letter gets a slash before it and keeps its colon."""
    path = F.replace(path, F.lit(BS), F.lit("/"))
    path = F.when(F.regexp_like(path, F.lit("^[A-Za-z]:")), F.concat(F.lit("/"), path)).otherwise(path)
    encoded = F.transform(F.split(path, "/"), lambda s: F.when(F.regexp_like(s, F.lit("^[A-Za-z]:$")), s).otherwise(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))))
    return F.concat(F.lit("file://"), F.array_join(encoded, "/"))


def uri_to_path(uri: Column) -> Column:
    return F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), "^/([A-Za-z]:)", "$1"), "/"), lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))), "/")


def short_id(uri: Column) -> Column:
    """Last segment, initials of the segments before it and eight digits of a hash: a short name of a uri."""
    segments = F.split(F.regexp_replace(uri, "^[a-z]+://", ""), "/")
    initials = F.array_join(F.transform(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: F.substring(s, 1, 1)), "")
    return F.concat_ws("-", F.element_at(segments, -1), initials, F.substring(F.md5(uri.cast("binary")), 1, 8))


def query_decode(text: Column) -> Column:
    """A uri as it stands in a query: a plus is no space, colons may be escaped."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def navigatable(uri: Column) -> Column:
    """Places that an editor can open; those of bundled sources are not."""
    return uri.startswith("file://")


def insert_text(full: Column, typed: Column) -> Column:
    """What is left to insert of a namespace after the typed prefix."""
    f, t = F.regexp_replace(full, r"^\\", ""), F.regexp_replace(typed, r"^\\", "")
    return F.when(f.startswith(t) & (t != ""), F.substring(f, F.length(t) - F.length(last_segment(t)) + 1, F.length(f))).otherwise(f)
