"""The prefix trie of conversations, and what sharing prefixes saves.

A node is a distinct sequence of first turns. Its digest is a sum of hashes of (place, turn), so the
digests of all prefixes are running sums, which are cut into blocks and need no walk from turn to turn.
Rows of one digest are counted with partial sums; a node whose rows disagree in their last turn or in
the digest before it would be a collision, and then all digests are drawn anew.

Subtrees of at most `SUBTREE_ROWS` turns are dealt to shards whole. A shard gives its nodes the slots of a minimal
perfect hash, scatters their counts into flat arrays, and adds them up through the array of parents'
slots, deepest first. The nodes above them, few where the data branch, are added up over the cluster by doubling:
each round every node adds its sum to the ancestor twice as far away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import number_sorted, sort_rows
from .blobs import width
from .perfecthash import PerfectHash
from .tables import stored
from .textblocks import mix

#: Conversations whose ids share the quotient by this take their first turns from its first one.
FAMILY = 20
#: At most this many turns, less one, are taken over.
HEADS = 4
#: A subtree with more turns than this, counted for every conversation, is not given to one shard.
SUBTREE_ROWS = 512
#: Nodes of a shard, about.
SHARD_NODES = 1 << 15
#: Turns of a conversation that one task sums up.
BLOCK = 4096

NODE = ["depth", "x", "y"]
PARENT = ["up", "px", "py"]
_LOW = (1 << 32) - 1
_SUMS = ["s0", "s1", "s2", "s3"]


def rebuild(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations ``(conv, depth, last, words, len)``, and ``(conv, len)`` of all.

    Turns are ordered by ``turn``, null first, equal ones by role and text digest; ``last`` is the SHA-256 of a turn's
    role and text. The first h turns are those of the family's first conversation, h from the id's CRC.
    Rows without a ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"),
        "turn",
        role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("last"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    ordered = number_sorted(turns, ["conv"], ["turn", "role", "last"], "place").select("conv", "place", "last", "words")
    numbered = stored(ordered, "turns")

    taken = numbered.where((F.col("conv") % family == 0) & (F.col("place") < heads))
    first = taken.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "last", "words"))).alias("first"))
    sizes = numbered.groupBy("conv").agg(F.count("*").alias("own")).withColumns(
        {"base": F.col("conv") - F.col("conv") % family, "h": F.crc32(F.col("conv").cast("string")) % heads}
    )
    joined = sizes.join(first, "base", "left")
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<place:bigint,last:string,words:bigint>>")), F.lit(1), F.col("h").cast("int"))
    sized = joined.withColumn("head", head).withColumn("shift", F.size("head") - F.col("h"))
    convs = stored(sized.withColumn("len", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")

    own = numbered.join(convs.select("conv", "h", "shift", "len"), "conv").where(F.col("place") > F.col("h"))
    shown = own.select("conv", (F.col("place") + F.col("shift")).alias("depth"), "last", "words", "len")
    over = convs.select("conv", "len", F.explode("head").alias("t")).select("conv", F.col("t.place").alias("depth"), "t.last", "t.words", "len")
    return shown.unionByName(over), convs.select("conv", "len")


def _digests(turns: DataFrame, seed: int) -> DataFrame:
    """Every turn with the digest ``(depth, x, y)`` of its prefix, and that of the one before it."""
    a, b = F.xxhash64(F.lit(2 * seed), "depth", "last"), F.xxhash64(F.lit(2 * seed + 1), "last", "depth")
    parts = [F.shiftrightunsigned(a, 32), a.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(_LOW))]
    rows = turns.withColumns({f"own{i}": p for i, p in enumerate(parts)} | {"block": F.floor((F.col("depth") - 1) / BLOCK)})
    inside = W.partitionBy("conv", "block").orderBy("depth")
    running = rows.repartition("conv", "block").withColumns({s: F.sum(f"own{i}").over(inside) for i, s in enumerate(_SUMS)})
    across = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(*[F.sum(f"own{i}").alias(f"t{i}") for i in range(4)])
    before = totals.select("conv", "block", *[F.coalesce(F.sum(f"t{i}").over(across), F.lit(0)).alias(f"b{i}") for i in range(4)])
    summed = running.join(before.repartition("conv", "block"), ["conv", "block"])

    def packed(high: Column, low: Column) -> Column:
        return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))

    here = [F.col(s) + F.col(f"b{i}") for i, s in enumerate(_SUMS)]
    up = [h - F.col(f"own{i}") for i, h in enumerate(here)]
    return summed.select(
        "conv", "depth", "last", "words", "len",
        packed(*here[:2]).alias("x"), packed(*here[2:]).alias("y"), packed(*up[:2]).alias("px"), packed(*up[2:]).alias("py"),
    )


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix, the root included; ``collides`` if its rows disagree."""
    same = [F.min(c) != F.max(c) for c in ("last", "px", "py")]
    weight = F.sum(F.col("len") - F.col("depth") + 1)
    counted = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"), weight.alias("weight"),
        F.min("px").alias("px"), F.min("py").alias("py"), (same[0] | same[1] | same[2]).alias("collides"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    above = root.select(
        *[zero.alias(c) for c in NODE], "conv", "n_convs", zero.alias("words"), none.alias("weight"),
        none.alias("px"), none.alias("py"), F.lit(False).alias("collides"),
    )
    return counted.unionByName(above)


_FOUND = "depth bigint, x bigint, y bigint, conv bigint, n_convs bigint, px bigint, py bigint, parent_conv bigint, n_children bigint, n_leaves bigint, saved bigint"


def _keys(depth: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(x.view(np.uint64), seed) + mix(y.view(np.uint64), seed + 1) + depth.astype(np.uint64))


def add_up(table: pa.Table) -> pa.Table:
    """A shard's nodes with the sums over their subtrees; those whose parent lies elsewhere have no ``parent_conv``."""
    col = {c: table.column(c).to_numpy() for c in ("depth", "x", "y", "conv", "n_convs", "words", "px", "py")}
    n = len(col["x"])
    for seed in count():
        keys = _keys(col["depth"], col["x"], col["y"], seed)
        if len(np.unique(keys)) == n:
            break
    table_of = PerfectHash(keys)
    slot = table_of.slots(keys)
    flat = {c: np.empty(n, np.int64) for c in col}
    for c, values in col.items():
        flat[c][slot] = values

    # A parent counts only if its slot holds its very digest.
    parent = table_of.slots(_keys(flat["depth"] - 1, flat["px"], flat["py"], seed))
    known = parent >= 0
    for own, other in (("px", "x"), ("py", "y")):
        known &= flat[own] == flat[other][parent]
    known &= flat["depth"] - 1 == flat["depth"][parent]

    children = np.bincount(parent[known], minlength=n)
    leaves = (children == 0).astype(np.int64)
    saved = (flat["n_convs"] - 1) * flat["words"]
    order = np.argsort(-flat["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(flat["depth"][order])) + 1
    for level in np.split(order, cuts):
        level = level[known[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = pa.array(np.where(known, flat["conv"][parent], 0), mask=~known)
    names = ["depth", "x", "y", "conv", "n_convs", "px", "py"]
    return pa.table({c: flat[c] for c in names} | {"parent_conv": up, "n_children": children, "n_leaves": leaves, "saved": saved})


def _heavy_sums(heavy: DataFrame, light_roots: DataFrame) -> DataFrame:
    """The nodes above the shards' subtrees, with sums over all below them."""
    below = light_roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count("*").alias("l_children"), F.sum("n_leaves").alias("l_leaves"), F.sum("saved").alias("l_saved")
    )
    inner = heavy.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("h_children"))
    zero = F.lit(0).cast("bigint")
    children = F.coalesce("l_children", zero) + F.coalesce("h_children", zero)
    table = heavy.join(below, NODE, "left").join(inner, NODE, "left").select(
        *NODE, "conv", "n_convs", "px", "py", children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.coalesce("l_leaves", zero)).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("l_saved", zero)).alias("saved"),
        (F.col("depth") - 1).alias("up"), F.col("px").alias("ux"), F.col("py").alias("uy"),
    )
    table = stored(table, "heavy")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    reach, ancestor = 1, ["up", "ux", "uy"]
    while reach <= deepest:
        known = table.where("up >= 0")
        gains = known.groupBy(*[F.col(a).alias(c) for a, c in zip(ancestor, NODE, strict=True)]).agg(F.sum("n_leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))
        further = table.select(*[F.col(c).alias(a) for c, a in zip(NODE, ancestor, strict=True)], *[F.col(a).alias(f"n{a}") for a in ancestor])
        moved = table.join(gains, NODE, "left").join(further, ancestor, "left")
        sums = {"n_leaves": F.col("n_leaves") + F.coalesce("g_leaves", zero), "saved": F.col("saved") + F.coalesce("g_saved", zero)}
        far = [F.coalesce("nup", F.lit(-1).cast("bigint")).alias("up"), F.col("nux").alias("ux"), F.col("nuy").alias("uy")]
        kept = [c for c in table.columns if c not in (*sums, *ancestor)]
        table = stored(moved.withColumns(sums).select(*kept, *sums, *far), "heavy")
        reach *= 2
    return table.drop(*ancestor)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, in order, to one hash for each node."""
    now, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*now, state.hexdigest()), strict=True))])

    for batch in batches:
        for row in batch.to_pylist():
            node = tuple(row[c] for c in NODE)
            if node != now:
                if now is not None:
                    yield done()
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["ids"].encode())
    if now is not None:
        yield done()


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The hash of the ids of the conversations that end at a node.

    Ids are sorted and joined in parts of the sort; only the joined parts of a node meet, one after another.
    """
    zero = F.lit(0).cast("bigint")
    whole = rows.where("depth = len").select(*NODE, "conv").unionByName(convs.where("len = 0").select(*[zero.alias(c) for c in NODE], "conv"))
    parts = sort_rows(whole, NODE, ["conv"]).groupBy(*NODE, "_part")
    joined = parts.agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    in_order = joined.repartition(*NODE).sortWithinPartitions(*NODE, "_part")
    return in_order.mapInArrow(_hashed, "depth bigint, x bigint, y bigint, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, subtree_rows: int = SUBTREE_ROWS
) -> DataFrame:
    """One row per node of the rebuilt conversations' trie.

    Columns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. A missing role or text is empty, and repeated rows are turns of their own. Rows without a
    ``conv_id`` are left out, as they belong to no conversation; other columns are ignored. An empty table gives
    no rows, not even a root.
    """
    turns, convs = rebuild(conversations, family, heads)
    turns = stored(turns, "rebuilt")
    for seed in count():
        rows = stored(_digests(turns, seed), "digests")
        nodes = stored(_nodes(rows, convs), "nodes")
        if not nodes.where("collides").limit(1).count():
            break
    # Without a weight: the root, which is never given to a shard.
    is_light = F.coalesce(F.col("weight") <= subtree_rows, F.lit(False))
    heavy = nodes.where(~is_light)
    reached = rows.join(heavy.where("depth > 0").select(*NODE), NODE).groupBy("conv").agg(F.max("depth").alias("heavy"))
    tops = rows.join(reached, "conv", "left").where(F.col("depth") == F.coalesce("heavy", F.lit(0)) + 1)
    shards = max(width(rows.sparkSession), -(-nodes.count() // SHARD_NODES))
    shard = F.pmod(F.xxhash64(*NODE), F.lit(shards)).cast("int").alias("shard")
    light = nodes.where(is_light).join(tops.select("conv", shard), "conv")
    found = stored(light.groupBy("shard").applyInArrow(add_up, _FOUND), "light")

    above = _heavy_sums(heavy, found.where("parent_conv IS NULL"))
    names = heavy.select(F.col("depth").alias("up"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv"))
    cut = found.where("parent_conv IS NULL").drop("parent_conv").unionByName(above).withColumn("up", F.col("depth") - 1)
    named = cut.join(names, PARENT, "left").drop("up")
    whole = found.where("parent_conv IS NOT NULL").unionByName(named)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return whole.join(_ends(rows, convs), NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
