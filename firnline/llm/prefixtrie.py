"""The trie of conversations that begin alike: what a shared prefix saves, summed over every subtree.

Turns are placed by a sort over all conversations, so that one conversation may hold any share of the rows. A node is
named by a digest of its turns: folded within blocks of a conversation, the blocks joined by doubling their reach.
Leaf counts and savings climb by pointer jumping: in round k every node hands its sums to its ancestor 2^k above and
takes over that ancestor's pointer, so the number of rounds is the logarithm of the depth and only nodes at least 2^k
deep take part. Every table of a round lies in the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.storage import Scratch

#: Turns that are folded together; longer conversations have several blocks.
BLOCK = 64
#: Conversation ids of one piece of the list of a node's ends.
PIECE = 1024
#: Turns with equal ``turn`` follow the beginnings of role and text, so that sort keys stay short, then the digest.
KEY_CHARS = 32
ROOT = b""


def _digest(x: Column) -> Column:
    return F.unhex(F.substring(F.sha2(x, 256), 1, 32))


def placed_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, pos from 1, digest, points) of every turn, and (conv, n) of every conversation.

    Order: turn (null first), the first 32 code points of role and of text, digest. A null role or text is empty;
    rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Texts of
    any length are read whole but only digests and lengths are shuffled; other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.substring(role, 1, KEY_CHARS).alias("r"), F.substring(text, 1, KEY_CHARS).alias("t"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
        F.char_length(text).cast("long").alias("points"), F.rand(11).alias("apart"),
    )
    keys = ["conv", "turn", "r", "t", "digest"]
    ordered = turns.repartitionByRange(*keys, "apart").sortWithinPartitions(*keys)
    rows = scratch.put(ordered.select("conv", "digest", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "turns")
    # one row for each partition of the sort, so the frame is bounded by their number
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(parts), "part").select("conv", "digest", "points", (F.col("base") + F.col("row")).alias("at"))
    convs = scratch.put(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "convs")
    return rows.join(convs, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "digest", "points"), convs.select("conv", "n")


def _pairs_of_blocks(blocks: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(conv, block, ahead, above) of blocks after the first: digest of all blocks before it, and the name of the node just above it."""
    now, reach, name = blocks, 1, ""
    while reach <= most:
        left = now.select("conv", (F.col("block") + reach).alias("block"), F.col("digest").alias("head"))
        nxt = scratch.put(now.join(left, ["conv", "block"], "left").select("conv", "block", F.when(F.col("head").isNull(), F.col("digest")).otherwise(_digest(F.concat("head", "digest"))).alias("digest")), f"reach{reach}")
        if name:
            scratch.drop(name)
        now, name, reach = nxt, f"reach{reach}", 2 * reach
    ahead = now.select("conv", (F.col("block") + 1).alias("block"), F.col("digest").alias("ahead"))
    before = blocks.join(ahead, ["conv", "block"], "left").select("conv", (F.col("block") + 1).alias("block"), _digest(F.concat(F.coalesce("ahead", F.lit(ROOT)), "digest")).alias("above"))
    return ahead.join(before, ["conv", "block"])


def _named(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, points, key, parent) of every prefix of every conversation."""
    within = Window.partitionBy("conv", "block").orderBy("pos")
    folded = turns.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).select(
        "conv", "block", "pos", "points", _digest(F.concat_ws("", F.collect_list("digest").over(within.rowsBetween(Window.unboundedPreceding, 0)))).alias("fold"))
    folded = scratch.put(folded, "folded")
    most = folded.agg(F.max("block")).first()[0] or 0
    if most:
        blocks = scratch.put(folded.where(f"pos % {BLOCK} = 0").select("conv", "block", F.col("fold").alias("digest")), "blocks")
        folded = folded.join(scratch.put(_pairs_of_blocks(blocks, most, scratch), "ahead"), ["conv", "block"], "left")
    else:
        folded = folded.withColumns({"ahead": F.lit(None).cast("binary"), "above": F.lit(None).cast("binary")})
    key = _digest(F.concat(F.coalesce("ahead", F.lit(ROOT)), "fold"))
    keyed = folded.select("conv", "block", "pos", "points", "above", key.alias("key"))
    return keyed.select("conv", F.col("pos").alias("depth"), "points", "key", F.coalesce(F.lag("key").over(within), "above", F.lit(ROOT)).alias("parent"))


def _pieces(batches):
    """Runs of one key in sorted rows (key, conv) as comma-joined lists of at most ``PIECE`` ids."""
    key, held = None, []

    def out():
        return {"key": key, "first": held[0], "ids": ",".join(map(str, held))}

    for batch in batches:
        done = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (k != key or len(held) == PIECE):
                done.append(out())
                held = []
            key = k
            held.append(conv)
        if done:
            yield pa.RecordBatch.from_pylist(done, PIECES)
    if held:
        yield pa.RecordBatch.from_pylist([out()], PIECES)


def _hashes(batches):
    """SHA-256 of each key's pieces joined by commas, from sorted rows (key, first, ids): only the state of one key is held."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append({"key": key, "ends_sha256": state.hexdigest()})
            key, state = k, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, HASHES)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], HASHES)


PIECES = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv); a list of any length is cut into pieces by Spark, and a task that hashes one reads only its pieces, in order."""
    pieces = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def _climbed(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each round the sums (key, leaves, saved) that nodes get from descendants at a distance of 2^k to 2^(k+1) - 1."""
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    own = nodes.join(kids, "key", "left").select(
        "key", "depth", F.col("parent").alias("pointer"), F.coalesce("children", F.lit(0)).alias("children"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    own = scratch.put(own, "own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    sums, senders, step, at = [own.select("key", "leaves", "saved", "children")], own.where("depth >= 1").select("key", "depth", "pointer", "leaves", "saved"), 1, 0
    while step <= deepest:
        got = scratch.put(senders.groupBy(F.col("pointer").alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"got{at}")
        sums.append(got.withColumn("children", F.lit(0).cast("long")))
        if 2 * step <= deepest:
            jumps = senders.select(F.col("key").alias("pointer"), F.col("pointer").alias("further"))
            # at a depth of twice the step the further ancestor is the root; below it, the pointer's own pointer
            near = senders.where(f"depth = {2 * step}").withColumn("pointer", F.lit(ROOT))
            far = senders.where(f"depth > {2 * step}").join(jumps, "pointer").select("key", "depth", F.col("further").alias("pointer"), "leaves", "saved")
            more = got.select("key", F.col("leaves").alias("l"), F.col("saved").alias("s"))
            moved = near.unionByName(far).join(more, "key", "left")
            nxt = scratch.put(moved.select("key", "depth", "pointer", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), f"senders{at}")
            if at:
                scratch.drop(f"senders{at - 1}")
            senders = nxt
        step, at = 2 * step, at + 1
    return sums


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the trie: key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos (gapless from 1), digest (hex) and points; ``convs`` has conv and n, the number of its
    turns, also for conversations without turns, which end at the root. No conversations give no rows, not even a root.
    """
    named = _named(turns, scratch)
    top = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("points"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"))
    rows = scratch.put(named.unionByName(top), "prefixes")
    nodes = scratch.put(rows.groupBy("key", "parent", "depth", "points").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    ends = scratch.put(_end_hashes(rows.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("key", "conv")), "ends")
    parts = _climbed(nodes, scratch)
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy("key").agg(*(F.sum(c).alias(o) for c, o in (("leaves", "n_leaves"), ("saved", "saved_tokens"), ("children", "n_children"))))
    whole = scratch.put(nodes.join(total, "key").join(ends, "key", "left"), "whole")
    scratch.drop("prefixes", "folded", "turns", "ends")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, "parent", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table conv_id, turn, role, text as it stands; the cases are those of ``placed_turns`` and ``trie``."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = placed_turns(conversations, scratch)
    return trie(turns, convs, scratch)


def rebuilt(turns: DataFrame, convs: DataFrame, scratch: Scratch, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation c has got the first h turns of c - c % group for its own first h; h = crc32(c) % most.

    A group has at most 2 * group conversations, so a head's turns are repeated a bounded number of times.
    """
    conv, h = F.col("conv"), F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = convs.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    plan = convs.withColumn("head", conv - conv % group).withColumn("h", h).join(heads, "head", "left")
    plan = plan.select("conv", "head", "h", "n", F.least("h", F.coalesce("head_n", F.lit(0))).alias("taken"))
    plan = scratch.put(plan.select("conv", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "plan")
    turns = scratch.put(turns, "placed")
    own = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "points")
    shared = turns.where((F.col("pos") < most) & (conv % group == 0)).select(conv.alias("head"), "pos", "digest", "points")
    lent = plan.where("taken > 0").join(shared, "head").where("pos <= taken").select("conv", "pos", "digest", "points")
    return own.unionByName(lent), plan.select("conv", "n")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt in groups of a hundred; node keys are not returned."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(*placed_turns(conversations, scratch), scratch)
    return trie(turns, convs, scratch).drop("key", "parent")
