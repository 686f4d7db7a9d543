"""The prefix trie of conversations: succinct level-order tries of prefix shards, and a merge of the heavy upper levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut
from .mixing import word_count

#: A prefix with more turns than this below it belongs to the upper levels; the subtree of any other fits one task.
SHARD_TURNS = 100_000
#: Nodes of the upper levels that one task takes; beyond it their deepest level is merged apart, again and again.
UPPER_NODES = 1_000_000
#: Conversation ids that one row holds while they are brought in order.
ID_BLOCK = 4096
#: The digest of the empty sequence, which is the root's.
ROOT = bytes(16)
NODE_BYTES = 64
#: Stands for the parent of the root; no digest is as long.
NOTHING = b"\xff" * 17


class Louds:
    """A forest in level order: for each node, from a root above all on, a one for each child and then a zero.

    labels, ids and all other arrays follow the nodes' level order. The parent of the node of the i-th one is the number
    of zeros before that one, which is all that walks up need.
    """

    def __init__(self, bits: np.ndarray, levels: np.ndarray):
        self.bits, self.levels = bits, levels

    @classmethod
    def build(cls, ids: np.ndarray, parents: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of nodes (ids, those of their parents) and the nodes' level order. A node whose parent isn't among
        them hangs from the root above all."""
        n = len(ids)
        names, where = np.unique(np.concatenate([ids, parents]), return_inverse=True)
        own = np.full(len(names), -1)
        own[where[:n]] = np.arange(n)
        parent = own[where[n:]]
        count = np.bincount(parent[parent >= 0], minlength=n)
        by_parent = np.lexsort((where[:n], parent))
        start = np.searchsorted(parent[by_parent], np.arange(n))
        level = by_parent[: int((parent < 0).sum())]
        order, per_node = [], [np.array([len(level)])]
        while len(level):
            order.append(level)
            per_node.append(count[level])
            before = np.cumsum(count[level]) - count[level]
            level = by_parent[np.repeat(start[level] - before, count[level]) + np.arange(int(count[level].sum()))]
        per_node = np.concatenate(per_node)
        bits = np.ones(int(per_node.sum()) + len(per_node), bool)
        bits[np.cumsum(per_node + 1) - 1] = False
        return cls(bits, np.cumsum([0, *map(len, order)])), np.concatenate(order) if order else np.zeros(0, np.int64)

    def parents(self) -> np.ndarray:
        """The parent of each node, -1 for the roots of the forest."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        """How many children each node has."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def up(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each node's subtree: from the last level to the first, each node is added to its parent."""
        total, parent = values.copy(), self.parents()
        for a, z in reversed(list(pairwise(self.levels[1:].tolist()))):
            np.add.at(total, parent[a:z], total[a:z])
        return total


def turn_label(role: Column, text: Column) -> Column:
    """128 bits of a role and a text, null as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def label_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), label and words of each turn, without the texts. Turns are ordered by their number, null first,
    and then by label, so that ties have an order; rows without a conversation id belong to none and are left out."""
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_label(F.col(role_col), F.col(text_col)).alias("label"), word_count(F.col(text_col)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "label", "words")


def _paths(labelled: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation and prefix, the empty one included: conv_id, depth, id and parent (digests of prefixes),
    words of its last turn, last, and below, the turns from there on.

    A task reads the sorted turns of its conversations as a stream and keeps one digest, so a conversation may be of any length.
    """
    roots = conversations.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"))
    rows = labelled.select("conv_id", "pos", "label", "words").unionByName(roots)
    size = F.count("*").over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("size", size).sortWithinPartitions("conv_id", "pos")
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("last", pa.bool_()), ("below", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, depth = ROOT, 0
        for b in batches:
            labels, size = b.column("label").to_pylist(), b.column("size").to_numpy()
            ids, parents, depths = [], [], []
            for label in labels:
                if label is None:
                    ids.append(ROOT)
                    parents.append(None)
                    digest, depth = ROOT, 0
                else:
                    parents.append(digest)
                    digest = hashlib.md5(digest + label, usedforsecurity=False).digest()
                    ids.append(digest)
                    depth += 1
                depths.append(depth)
            d = np.array(depths, np.int64)
            yield pa.record_batch([b.column("conv_id"), pa.array(d), pa.array(ids, pa.binary()), pa.array(parents, pa.binary()), b.column("words"), pa.array(d == size - 1), pa.array(size - d)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, depth long, id binary, parent binary, words long, last boolean, below long")


def _whole_shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by shard, in tables that hold whole shards."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        shard = t.column("shard").chunk(0)
        ends = np.flatnonzero(pc.not_equal(shard.slice(1), shard.slice(0, len(shard) - 1)).to_numpy(zero_copy_only=False))
        if len(ends):
            yield t.slice(0, int(ends[-1]) + 1)
            held = t.slice(int(ends[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


KEPT = {"id": "binary", "parent": "binary", "depth": "long", "conv_id": "long", "n_convs": "long", "ends": "long", "one_end": "long"}
ROLLED = {**KEPT, "parent_conv_id": "long", "n_children": "long", "n_leaves": "long", "saved": "long"}


def _rolled(nodes: DataFrame, most: int) -> DataFrame:
    """Sums over subtrees within shards: nodes (shard, KEPT, and own_children, own_leaves and own_saved, which bring in what
    lies below in other shards), sorted by shard, to ROLLED. The roots of shards have no parent_conv_id yet."""
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(c, kinds[t]) for c, t in ROLLED.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_shards(batches, most):
            ids, parents = (np.array([x or NOTHING for x in t.column(c).to_pylist()], f"V{len(NOTHING)}") for c in ("id", "parent"))
            trie, order = Louds.build(ids, parents)
            t = t.take(pa.array(order)).combine_chunks()
            children = trie.children() + t.column("own_children").to_numpy()
            leaves = trie.up(t.column("own_leaves").to_numpy() + (children == 0))
            saved, parent = trie.up(t.column("own_saved").to_numpy()), trie.parents()
            above = pa.array(t.column("conv_id").to_numpy()[parent], mask=parent < 0)
            out = pa.table([*[t.column(c) for c in KEPT], above, pa.array(children), pa.array(leaves), pa.array(saved)], schema=schema)
            yield from out.to_batches(max_chunksize=10_000)

    return nodes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in ROLLED.items()))


def _sent(df: DataFrame, row_bytes: int = NODE_BYTES) -> DataFrame:
    """df, a checkpoint, as a broadcast if it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the ids (id, conv_id) of each prefix, ascending and comma-joined. Blocks of ID_BLOCK ids are put in order
    apart, and a task reads them as a stream, so no list of ids is ever whole in memory."""
    blocks = ends.groupBy("id", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h = None, None
        for b in batches:
            found = []
            for name, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if name == own:
                    h.update(b"," + ids.encode())
                    continue
                if h:
                    found.append((own, h.hexdigest()))
                own, h = name, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], schema=schema)
        if h:
            yield pa.record_batch([pa.array([own], pa.binary()), pa.array([h.hexdigest()])], schema=schema)

    return blocks.repartition("id").sortWithinPartitions("id", "block").mapInArrow(run, "id binary, ends_sha256 string")


def prefix_trie(labelled: DataFrame, conversations: DataFrame, shard_turns: int = SHARD_TURNS, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """Every distinct prefix of the conversations as a node of a trie.

    labelled: conv_id, pos, label, words of each turn (see label_turns); conversations: conv_id of each conversation, once,
    of those without turns too. A prefix is known by a chained 128-bit digest. Prefixes are counted with partial sums, so
    that a turn that very many conversations start with is no hot key. A prefix with more than shard_turns turns below it,
    copies included, is of the upper levels; every other lies in the shard of the first such prefix on its way, so a
    shard has at most shard_turns nodes. Each task builds succinct tries of its shards and sums them up in reverse level
    order; the shards' totals then go to the upper levels, which are a trie of their own (their deepest levels are merged
    by joins while they have more than upper_nodes nodes, a round of jobs a level).

    Returns id, parent (null for the root), depth, conv_id (the smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends (how many conversations end there) and ends_sha256 of their ids. Without conversations
    there is no node, not even the root. Null roles and texts are empty, and very long texts are only hashed. Repeated
    rows are turns of their own. Extra columns are left out, whatever their names.
    """
    paths = cut(_paths(labelled, conversations))
    nodes = cut(paths.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("one_end"), ((F.count("*") - 1) * F.first("words")).alias("own_saved"), F.sum("below").alias("below"),
    ))
    none = [F.lit(0).cast("long").alias(c) for c in ("own_children", "own_leaves")]
    upper = cut(nodes.where(F.col("below") > shard_turns).select(*KEPT, *none, "own_saved"))
    light = nodes.where(F.col("below") <= shard_turns).select(*KEPT, *none, "own_saved")
    if upper.limit(1).count():
        # where each conversation leaves the upper levels; all members of a prefix do so at the same place
        names = _sent(upper.select(F.col("id").alias("name")))
        leave = paths.join(names, F.col("parent") == F.col("name"), "left_semi").join(names, F.col("id") == F.col("name"), "left_anti")
        light = light.join(leave.select("conv_id", F.col("id").alias("shard")), "conv_id")
    else:
        light = light.withColumn("shard", F.lit(ROOT))
    shards = cut(_rolled(light.repartition("shard").sortWithinPartitions("shard"), shard_turns))
    done = [shards]

    def add(rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows of the upper levels with what the roots of subtrees (parent, n_leaves, saved) bring to them."""
        below = found.groupBy(F.col("parent").alias("over")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        own = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("own_children", "c"), ("own_leaves", "l"), ("own_saved", "s"))]
        return cut(rows.join(below, F.col("id") == F.col("over"), "left").select(*KEPT, *own))

    upper_names = upper.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    upper = add(upper, shards.where("parent_conv_id is null and parent is not null"))
    while upper.count() > upper_nodes:
        deepest = upper.agg(F.max("depth")).first()[0]
        leaves = F.col("own_leaves") + F.when(F.col("own_children") == 0, 1).otherwise(0)
        level = upper.where(F.col("depth") == deepest).select(*KEPT, F.lit(None).cast("long").alias("parent_conv_id"), F.col("own_children").alias("n_children"), leaves.alias("n_leaves"), F.col("own_saved").alias("saved"))
        done.append(level)
        upper = add(upper.where(F.col("depth") < deepest), level)
    # one task, for a bounded table
    done.append(_rolled(upper.withColumn("shard", F.lit(ROOT)).repartition(1), upper_nodes + 1))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    # only the roots of shards, and upper levels that were merged apart, hang from another table
    whole = cut(whole)
    hung = F.col("parent_conv_id").isNull() & F.col("parent").isNotNull()
    found = whole.where(~hung).unionByName(whole.where(hung).drop("parent_conv_id").join(_sent(cut(upper_names)), "parent").withColumnRenamed("above", "parent_conv_id"))
    many = cut(nodes.where("ends > 1").select("id"))
    digests = _digests(paths.where("last").join(_sent(many), "id", "left_semi").select("id", "conv_id"))
    found = found.join(digests, "id", "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("one_end").cast("string"), F.lit("")).cast("binary"), 256))
    return found.select("id", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends", sha.alias("ends_sha256"))


def rebuild(labelled: DataFrame, conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of rebuilt conversations: the first h turns of the conversation whose id is the next lower multiple of `every`,
    then the conversation's own turns after its first h, h being crc32 of the id as text modulo `most`.

    Of the conversations that give their first turns only the first `most` - 1 are gathered, so no list grows.
    """
    names = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    turn = F.struct("pos", "label", "words")
    heads = labelled.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    names = names.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,label:binary,words:long>>")), F.lit(1), F.col("h").cast("int")).alias("head"))
    names = cut(names)
    first = names.select("conv_id", F.inline("head"))
    own = labelled.join(names.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos >= h")
    return first.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "label", "words"))
