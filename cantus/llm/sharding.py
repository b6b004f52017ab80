"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A tree of regions, racks and shards has weights at its shards; an inner node weighs what its shards weigh together. A
row starts at the root and draws, for each child, ``-ln(u) / weight`` with ``u`` hashed from the child's name and the
row's key; it descends to the child of the least draw. A child is drawn with a probability in proportion to its weight,
and a draw changes only with its own child's weight. So when a shard's weight changes, rows only move into or out of
the nodes on the path to it: never between two subtrees whose weights stay. A shard that opens a region of its own
(``grown``) takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, text_of, written

#: Rows that one task numbers, and copies of a row that one task tells apart, on average.
NUMBERED = 1 << 18


@dataclass(frozen=True)
class Shard:
    """A leaf: its number and its place. Names of regions and racks are part of the draws, so they must stay."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


Tree = tuple[Shard, ...]


def balanced_tree(regions: int, racks: int, shards: int) -> Tree:
    """Equal shards, numbered depth first."""
    return tuple(Shard((g * racks + k) * shards + s, f"g{g}", f"k{k}") for g in range(regions) for k in range(racks) for s in range(shards))


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: all others' weights stay, so rows move only into it."""
    number = max((s.number for s in tree), default=-1) + 1
    return (*tree, Shard(number, f"g{number}+", "k0", weight))


def _children(tree: Tree) -> dict[str, list[tuple[float, str]]]:
    """(weight, name) of every inner node's children; the root's name is empty."""
    if len({s.number for s in tree}) != len(tree):
        raise ValueError("shards must have different numbers")
    if not any(s.weight > 0 for s in tree) or any(s.weight < 0 for s in tree):
        raise ValueError("weights must not be negative, and one must be positive")
    weights: dict[str, dict[str, float]] = {}
    for s in sorted(tree, key=lambda s: s.number):
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
        for parent, child in zip(path, path[1:]):
            held = weights.setdefault(parent, {})
            held[child] = held.get(child, 0.0) + float(s.weight)
    return {p: [(w, c) for c, w in held.items() if w > 0] for p, held in weights.items()}


def _hashed(text: Column) -> Column:
    """52 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a string key; the tree is a literal, as large as the caller's parameter."""
    children = _children(tree)
    table = F.create_map(*(x for p, held in children.items() for x in (F.lit(p), F.array(*(F.struct(F.lit(w).alias("weight"), F.lit(c).alias("name")) for w, c in held)))))
    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(table, node),
            lambda c: F.struct((-F.log((_hashed(F.concat(c["name"], F.lit(":"), key)) + F.lit(0.5)) / F.lit(float(1 << 52))) / c["weight"]).alias("draw"), c["name"].alias("name")),
        )
        node = F.array_min(draws)["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Gapless numbers from 0 within each group as ``slot``, in the order of the uniformly hashed ``h`` (52 bits) and of ``order``.

    ``rows`` has a count ``n`` and no two rows that agree in group, h and order. A group may hold any share of the
    rows: it is numbered in equal ranges of h, each of which starts at the sum of those before it.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total // NUMBERED).bit_length())
    ranged = rows.withColumn("range", F.shiftright("h", 52 - bits))
    sizes = ranged.groupBy(group, "range").agg(F.sum("n").alias("in_range"))
    # one row per group and range: a quarter of a million times fewer than there are rows
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("range").alias("_range"), F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(group, "range").orderBy("h", *(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = first.join(starts.hint("merge"), (F.col(group) == F.col("_group")) & (F.col("range") == F.col("_range"))).withColumn("first", F.col("base") + F.col("within"))
    # copies of a row: in runs of bounded length, which are dealt out before they are told apart
    step = 4096
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))))
    dealt = runs.repartition(partitions_for(spark, total, NUMBERED), group, "h", "run", *order)
    copy = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + (step - 1), F.col("n") - 1)))
    return dealt.withColumn("copy", copy).withColumn("slot", F.col("first") + F.col("copy")).select(*(c for c in rows.columns if c != "n"), "slot")


def place(docs: DataFrame, tree: Tree, more: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    The id alone decides the shard, among equal trees; a null id is a key of its own, and rows that share an id share
    a shard. ``slot`` numbers a shard's rows from 0 without gaps; copies of a row get different ones. ``more`` is the
    tree after a change (by default one more shard), whose shard is ``grown_shard``. Null texts have no bytes and size
    1. Other columns are ignored; an empty table gives no rows.
    """
    more = grown(tree) if more is None else more
    ident = F.col(id_col).cast("bigint")
    text = text_of(text_col).cast("binary")
    rows = docs.select(ident.alias("id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    # only ids and sums are shuffled; equal rows are one from here on, so no copy makes a task large
    held = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    placed = held.select("*", shard_of(key, tree).alias("shard"), shard_of(key, more).alias("grown"), _hashed(F.concat(key, F.lit(":"), F.col("crc").cast("string"))).alias("h"))
    out = numbered(written(placed, "shards"), "shard", ["id", "crc", "size"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))
