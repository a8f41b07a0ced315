"""Placing documents in shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` from a hash of
its name and the key, and the smallest draw wins, so a child is chosen in proportion to its weight. A
child's draw depends on that child alone: changing one weight moves keys only into or out of that child,
and nothing inside the other subtrees.

Capacity that is added later is a *layer* of a region with draws of its own at the top level. A grown tree
thus moves keys into the new layer only, which holds the new shard: one more shard takes keys only into itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.copies import numbered_copies


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: str
    region: str
    weight: float = 1.0
    layer: int = 0


@dataclass(frozen=True)
class Topology:
    leaves: tuple[Leaf, ...]

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in the last region's newest layer."""
        last = self.leaves[-1]
        layer = max(x.layer for x in self.leaves) + 1
        return Topology((*self.leaves, Leaf(max(x.shard for x in self.leaves) + 1, f"{last.region}/grown{layer}", last.region, weight, layer)))

    def reweighted(self, weights: dict[int, float]) -> Topology:
        return Topology(tuple(Leaf(x.shard, x.rack, x.region, weights.get(x.shard, x.weight), x.layer) for x in self.leaves))


def balanced(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2, weights: Sequence[float] | None = None) -> Topology:
    """``shards`` leaves in equal racks and regions."""
    if shards < 1:
        raise ValueError("a topology needs a shard")
    at = lambda i: (i // (shards_per_rack * racks_per_region), i // shards_per_rack)
    return Topology(tuple(Leaf(i, f"k{at(i)[1]}", f"r{at(i)[0]}", 1.0 if weights is None else float(weights[i])) for i in range(shards)))


def _draw(name: str, weight: float, key: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11) + F.lit(1)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _descend(children: Sequence[tuple[str, float, Callable[[], Column]]], key: Column) -> Column:
    """The value below the child with the least draw; ties go to the earlier child."""
    live = [x for x in children if x[1] > 0]
    if not live:
        raise ValueError("no child has a weight above zero")
    if len(live) == 1:
        return live[0][2]()
    won = F.array_min(F.array(*[F.struct(_draw(name, w, key).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(live)]))["i"]
    out = F.lit(None).cast("int")
    for i in reversed(range(len(live))):
        out = F.when(won == i, live[i][2]()).otherwise(out)
    return out


def _groups(leaves: Sequence[Leaf], by: Callable[[Leaf], object]) -> list[list[Leaf]]:
    out: dict[object, list[Leaf]] = {}
    for x in leaves:
        out.setdefault(by(x), []).append(x)
    return list(out.values())


def shard_of(key: Column, tree: Topology) -> Column:
    """The shard (int) of a key. A null key is a key of its own; equal keys share a shard."""
    hashed = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")))
    total = lambda xs: sum(x.weight for x in xs)

    def shards(xs: list[Leaf]) -> Column:
        return _descend([(f"shard:{x.shard}", x.weight, lambda x=x: F.lit(x.shard)) for x in xs], hashed)

    def racks(xs: list[Leaf]) -> Column:
        return _descend([(f"rack:{g[0].rack}", total(g), lambda g=g: shards(g)) for g in _groups(xs, lambda x: x.rack)], hashed)

    return _descend([(f"region:{g[0].region}:{g[0].layer}", total(g), lambda g=g: racks(g)) for g in _groups(tree.leaves, lambda x: (x.region, x.layer))], hashed)


def assign_shards(df: DataFrame, key: str, tree: Topology, out: str = "shard") -> DataFrame:
    """Adds the shard of each row: a projection, without a shuffle.

    Null keys share one shard; repeated rows share theirs; an empty table stays empty. A column that is already
    named ``out`` is replaced, other columns pass through.
    """
    return df.withColumn(out, shard_of(F.col(f"`{key}`"), tree))


def slotted(df: DataFrame, group: str, out: str = "slot", blocks: int = 1024) -> DataFrame:
    """Numbers the rows of each ``group`` from 0 without gaps; equal rows count as interchangeable.

    Equal rows are first counted, so a row repeated any number of times crosses the shuffle once per task. Rows
    fall in ``blocks`` hash blocks per group; block totals (at most groups x blocks rows) give each block's first
    slot, and each block is numbered on its own.
    """
    cols = df.columns
    block, copies, start = "_block", "_copies", "_start"
    rows = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias(copies)).withColumn(block, F.pmod(F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in cols]), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, block).agg(F.sum(copies).alias("n")).select(group, block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(group, block).orderBy(*[F.col(f"`{c}`") for c in cols if c != group]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(start) + F.coalesce(F.sum(copies).over(within), F.lit(0))
    numbered = rows.join(starts, [group, block]).select(*cols, copies, first.alias(start))
    each = numbered_copies(numbered, copies, "_number")
    return each.select(*cols, (F.col(start) + F.col("_number")).alias(out))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``key``. A null text has size 1 and the checksum of no bytes.
    """
    tree = balanced(shards)
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), tree.grown()).alias("grown_shard"),
    )
    return slotted(rows, "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
