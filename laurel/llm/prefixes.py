"""Prefix trie of conversations by vertical bitmaps.

A conversation is the sequence of its turns' digests. Conversations are range-partitioned and
sorted by that sequence, then by id, and cut into shards of a bounded number of conversations and
turns. A shard indexes each (position, turn) as a bitset of its conversations; a depth-first walk
intersects the parent's bitset with the posting of the next turn, which gives one child after the
other, their members by popcount, and the members that end there.

The order makes shards share little: only prefixes of a shard's first or last conversation can
also occur in another shard. All other nodes are final where they are found. The shared ones (edge
nodes, a few per shard) are added up over shards, and what they add to the subtrees above them runs
along those first and last conversations, so no subtree is ever gathered in one place and a prefix
that a third of all conversations share costs one row per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.words import filled, words
from laurel.session import cut_lineage, materialise

#: bounds of a shard, and so of its bitsets; one conversation may have more turns
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 1 << 16
DIGEST = 16
FAMILY = 20
ROOT = bytes(DIGEST)

PARTS = (
    "shard long, edge boolean, chains int, node binary, parent binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "words long, ends array<long>"
)


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends, node. A node is known by (conv_id, depth): its smallest member and how many of that
    member's turns it holds. ``ends`` are the members that end there, ascending; where ``node`` is
    given they are null and lie in ``ends`` below, in parts.

    ``ends``: node, first, ends: parts of one node's list, in the order of ``first``."""

    nodes: DataFrame
    ends: DataFrame


# --- conversations --------------------------------------------------------------------


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % 4).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, path, words): each conversation with its first
    turns replaced by those of the first conversation of its family of twenty.

    ``path`` is the 16-byte digests of the turns in a row, ``words`` the words of each. Turns follow
    ``turn`` (null first), ties role and digest; every row is a turn; null role or text is empty;
    rows without conv_id belong to no conversation; other columns are ignored.
    """
    c = F.col
    role, text = filled(c("role")), filled(c("text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        (c("conv_id") - c("conv_id") % FAMILY).alias("base"), "conv_id",
        F.struct(
            "turn", role.alias("role"),
            F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text))).alias("key"),
            F.size(words(text)).alias("words"),
        ).alias("t"),
    )
    # one shuffle: families stay together, only digests travel
    own = rows.repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("t")
    )
    turns = own.select("base", "conv_id", F.transform(
        "t", lambda x: F.struct(F.hex(x["key"]).alias("key"), x["words"].alias("words"))
    ).alias("t"))
    first = F.max(F.when(c("conv_id") == c("base"), F.slice("t", 1, 3))).over(
        Window.partitionBy("base")
    )
    h = head_length(c("conv_id"))
    lent = F.coalesce(F.slice(first, F.lit(1), h), F.slice("t", 1, 0))
    kept = F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0)))
    return turns.select("conv_id", F.concat(lent, kept).alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.key", "")).alias("path"), c("t.words").alias("words")
    )


# --- one shard ------------------------------------------------------------------------


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def shard_nodes(ids: list[int], paths: list[bytes], sizes: list[list[int]]) -> list[tuple]:
    """All nodes of a shard, parents first, as ``PARTS`` without the shard. The conversations come
    in the order of (path, id). Edge nodes leave their own share of leaves and savings, and their
    edge children, out of their counts."""
    count = len(ids)
    postings: list[dict[bytes, int]] = []
    ended: dict[int, int] = {}
    for s, path in enumerate(paths):
        bit, depth = 1 << s, len(path) // DIGEST
        while len(postings) < depth:
            postings.append({})
        for at in range(depth):
            key = path[at * DIGEST:(at + 1) * DIGEST]
            postings[at][key] = postings[at].get(key, 0) | bit
        ended[depth] = ended.get(depth, 0) | bit
    outer = (1 << (count - 1)) | 1
    nodes: list[dict] = []
    stack = [(0, (1 << count) - 1, -1, ROOT)]
    while stack:
        depth, bits, parent, name = stack.pop()
        low = (bits & -bits).bit_length() - 1
        edge = bool(bits & outer)
        ends = bits & ended.get(depth, 0)
        here = len(nodes)
        nodes.append({
            "depth": depth, "parent": parent, "edge": edge, "name": name if edge else None,
            "chains": (bits & 1) + 2 * (bits >> (count - 1)), "n": bits.bit_count(),
            "words": sizes[low][depth - 1] if depth else 0, "ends": [ids[b] for b in _bits(ends)],
            "first": None, "children": 0, "leaves": 0, "saved": 0,
        })
        rest = bits ^ ends
        while rest:
            at = (rest & -rest).bit_length() - 1
            key = paths[at][depth * DIGEST:(depth + 1) * DIGEST]
            child = rest & postings[depth][key]
            rest ^= child
            below = hashlib.md5(name + key).digest() if child & outer else b""
            stack.append((depth + 1, child, here, below))
    for node in reversed(nodes):
        own = [x for x in (node["first"], *node["ends"][:1]) if x is not None]
        node["first"] = min(own)
        if not node["edge"]:
            node["leaves"] += not node["children"]
            node["saved"] += (node["n"] - 1) * node["words"]
        if node["parent"] >= 0:
            up = nodes[node["parent"]]
            up["first"] = node["first"] if up["first"] is None else min(up["first"], node["first"])
            up["children"] += not node["edge"]
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    out = []
    for x in nodes:
        up = nodes[x["parent"]] if x["parent"] >= 0 else None
        out.append((
            x["edge"], x["chains"], x["name"], up["name"] if up else None, x["depth"], x["first"],
            up["first"] if up and not up["edge"] else None, x["n"], x["children"], x["leaves"],
            x["saved"], x["words"], x["ends"],
        ))
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list]]:
    ids, paths, sizes, turns = [], [], [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for conv_id, path, size in zip(*columns):
            if ids and (len(ids) == most or turns + len(size) > SHARD_TURNS):
                yield ids, paths, sizes
                ids, paths, sizes, turns = [], [], [], 0
            ids.append(conv_id)
            paths.append(path)
            sizes.append(size)
            turns += len(size)
    if ids:
        yield ids, paths, sizes


def shard_parts(sequences: DataFrame, most: int = SHARD_CONVERSATIONS) -> DataFrame:
    """(conv_id, path, words) to ``PARTS``: the nodes of every shard of ``most`` conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8,
                 pa.list_(pa.int64())]
        names = [x.split()[0] for x in PARTS.split(", ")]
        for shard in _shards(batches, most):
            columns = list(zip(*shard_nodes(*shard)))
            columns.insert(0, [number] * len(columns[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, types)], names
            )
            number += 1

    placed = sequences.select("conv_id", "path", "words").repartitionByRange(
        "path", "conv_id"
    ).sortWithinPartitions("path", "conv_id")
    return placed.mapInArrow(run, PARTS)


# --- all shards -----------------------------------------------------------------------


def trie(sequences: DataFrame, shard: int = SHARD_CONVERSATIONS) -> Trie:
    """The prefix trie of (conv_id, path, words); conv_id is unique and not null.

    The root (depth 0, no turn) has all conversations as members, those without turns included; an
    empty table has no node. One conversation's digests (16 bytes a turn) must fit in a task.
    """
    c = F.col
    parts = materialise(shard_parts(sequences, shard), "trie")
    edge = parts.filter("edge")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = edge.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"),
        F.max("depth").alias("depth"), F.max("words").alias("words"),
        *[F.sum(s).alias(s) for s in sums],
    )
    kids = merged.filter("parent IS NOT NULL").groupBy(c("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("kids")
    )
    counted = cut_lineage(merged.join(kids, "node", "left").withColumn(
        "n_children", c("n_children") + F.coalesce("kids", F.lit(0))
    ).withColumns({
        "own_leaf": (c("n_children") == 0).cast("bigint"),
        "own_saved": (c("n_convs") - 1) * c("words"),
    }))
    # every edge node hands its own share to the nodes above it, along one of its chains
    chains = edge.select("shard", "depth", "node", F.explode(
        F.filter(F.array(F.lit(1), F.lit(2)), lambda x: c("chains").bitwiseAND(x) > 0)
    ).alias("side"))
    owner = chains.groupBy("node").agg(F.min(F.struct("shard", "side")).alias("o"))
    shares = counted.join(owner, "node").select(
        "o.shard", "o.side", "depth", "own_leaf", "own_saved"
    )
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    flow = chains.join(shares, ["shard", "side", "depth"], "left").select(
        "node", F.sum(F.coalesce("own_leaf", F.lit(0))).over(below).alias("leaf"),
        F.sum(F.coalesce("own_saved", F.lit(0))).over(below).alias("saved"),
    ).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    edges = counted.join(flow, "node").select(
        "node", "parent", "depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs", "n_children", (c("n_leaves") + c("leaf")).alias("n_leaves"),
        (c("saved_tokens") + c("saved")).alias("saved_tokens"),
        F.lit(None).cast("array<bigint>").alias("ends"),
    )
    every = parts.filter("NOT edge").select(*edges.columns).unionByName(edges)
    root = counted.filter("depth = 0").select("conv_id").scalar()
    # the root is the parent of very many nodes: its member is one value, not a join
    known = every.filter("parent IS NULL OR depth <= 1").withColumn(
        "parent_conv_id", F.when(c("depth") == 1, root).otherwise(c("parent_conv_id"))
    )
    asked = every.filter("parent IS NOT NULL AND depth > 1").drop("parent_conv_id").join(
        counted.select(c("node").alias("parent"), c("conv_id").alias("parent_conv_id")),
        "parent",
    )
    lists = edge.filter(F.size("ends") > 0).select(
        "node", F.element_at("ends", 1).alias("first"), "ends"
    )
    return Trie(known.unionByName(asked).drop("parent"), lists)


def listed(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each node's whole list of ends. Parts arrive in order and
    are digested one by one, so no list is ever whole in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _digests(done)
        if node is not None:
            yield _digests([(node, digest.hexdigest())])

    texts = parts.select("node", "first", listed(F.col("ends")).alias("text"))
    return texts.repartition("node").sortWithinPartitions("node", "first").select(
        "node", "text"
    ).mapInArrow(run, "node binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())
    ], ["node", "ends_sha256"])


def with_end_digests(found: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``, the lowercase SHA-256 of their ends as decimal numbers,
    ascending, joined by commas."""
    whole = found.nodes.filter("node IS NULL").withColumn(
        "ends_sha256", F.sha2(listed(F.col("ends")), 256)
    )
    shared = found.nodes.filter("node IS NOT NULL").join(
        end_digests(found.ends), "node", "left"
    ).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return whole.unionByName(shared).drop("ends", "node")
