"""N-gram Jaccard join by PartEnum signatures, and the groups of near copies that it links."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHashes, components, cut, join_skewed, mix, sent_if_small, shingle_hashes, small, small_batches, texts_of

N, PERCENT = 5, 80
#: A band of sizes ends where the next begins, RATIO times as large.
RATIO = 1.6
#: Slots of the table that counts shingles; one is common if its slot holds COMMON more than the mean and eight times its root.
SLOT_BITS, COMMON, SEGMENTS = 20, 64, 64
#: Documents and bytes of text in a block of a cell; two blocks are compared in one task.
BLOCK_DOCS, BLOCK_BYTES = 512, 8 << 20
#: A group that reaches into more cells than this makes one cell of them.
WIDE = 16
#: Members of a group whose sketches are compared in one task, and those beyond which a group of a common element isn't narrowed.
NARROW, PASS = 256, 1024
#: Least and most bits of a sketch, as powers of two.
SKETCH_BITS = 6, 17
#: Bytes of a row that says which units of comparison a document takes part in.
ROW_BYTES = 128
#: Rank of elements that are common; others have eight times the binary log of their slot's count, below this.
COMMON_RANK = 255
#: Signatures that a task packs at once, and that one task of the meeting gets on average.
PACK, MEET = 1_500_000, 4_000_000
_SEEN, _HUBS = 500_000, 1 << 14
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a text: words are runs without ASCII space, A-Z lower-cased."""
    words = text.lower().split()
    return np.unique(shingle_hashes(hashes.of(words), n)) if words else np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap with about as many bits as a set has elements: a bit says if it got an odd number of them. Two
    sets differ in at least as many elements as their bitmaps in bits, also once the longer is folded."""
    low, high = SKETCH_BITS
    bits = 1 << min(max(low, (len(shingles) - 1).bit_length()), high)
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def _folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    while len(bitmap) > width:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def may_link(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix of the pairs of sets that their sizes and sketches don't rule out; its diagonal is False."""
    linked = np.zeros((len(sizes), len(sizes)), bool)
    widths = np.array([len(s) for s in sketches])
    far = math.ceil(math.log2(100 / percent))  # a partner's sketch is at most so many times doubled
    for width in np.unique(widths):
        own, other = np.flatnonzero(widths == width), np.flatnonzero((widths >= width) & (widths <= width << far))
        bits = np.stack([_folded(sketches[k], width) for k in other]).view(np.uint64)
        for i, row in zip(own, bits[widths[other] == width], strict=True):
            apart = np.bitwise_count(bits ^ row).sum(1).astype(np.int64)
            total, least, most = sizes[i] + sizes[other], np.minimum(sizes[i], sizes[other]), np.maximum(sizes[i], sizes[other])
            fits = ((100 + percent) * apart <= (100 - percent) * total) & (100 * least >= percent * most)
            linked[i, other] |= fits
            linked[other, i] |= fits
    np.fill_diagonal(linked, False)
    return linked


@cache
def bands() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return edges


@cache
def plan(band: int, percent: int) -> tuple[int, int]:
    """(groups, spare) of a band: two sets of at most its largest size that are similar enough differ in at most k
    elements, so of k // 2 + 1 + spare groups at least spare + 1 hold one difference or none."""
    edges = bands()
    k = (100 - percent) * 2 * (edges[band + 1] - 1) // (100 + percent)
    if not k:
        return 0, 0
    spare = 1 + k // 12
    return k // 2 + 1 + spare, spare


def tags(size: int, percent: int) -> list[int]:
    """The size bands in which a set may meet a partner that is at least as large."""
    edges = bands()
    own = bisect_right(edges, size) - 1
    found, band = [own], own + 1
    while percent * edges[band] <= 100 * size:
        found.append(band)
        band += 1
    return found


def _signatures(shingles: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set, those of common prefix elements apart (see `signatures`)."""
    out, thin = [], False
    rare = shingles[rank < COMMON_RANK]
    place, value = mix(rare * _A), mix(rare ^ _B)
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    own = tags(len(shingles), percent)
    for tag in own:
        groups, spare = plan(tag, percent)
        if not groups:
            continue  # only equal sets are similar enough, and they are one node
        part = ((place >> np.uint64(32)) % np.uint64(groups) * np.uint64(3) + (place & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
        n = np.bincount(part, minlength=3 * groups).reshape(groups, 3)
        # sums of 32-bit halves are exact in doubles up to 2 ** 21 elements, far beyond a document's
        a = np.bincount(part, low, 3 * groups).astype(np.uint64) * _A + np.bincount(part, high, 3 * groups).astype(np.uint64) * _C
        a = mix(a).reshape(groups, 3)
        base = np.arange(groups, dtype=np.uint64) * _B + np.full(groups, tag, np.uint64) * _C
        pairs = [(mix(a[:, i] * _A + a[:, j] * _B + base + np.uint64(i + j)), n[:, i] + n[:, j] > 0) for i, j in ((0, 1), (0, 2), (1, 2))]
        thin |= int((~np.logical_and.reduce([full for _, full in pairs])).sum()) > spare
        out += [sig[full] for sig, full in pairs]
    common = np.zeros(0, np.uint64)
    if thin:
        # by size band too, as two similar enough sets have one in common
        n = len(shingles) - -(-percent * len(shingles) // 100) + 1
        order = np.lexsort((shingles, rank))[:n]
        first = mix((shingles[order] ^ _C)[None, :] + (np.array(own, np.uint64) * _A)[:, None])
        often = rank[order] == COMMON_RANK
        out.append(first[:, ~often].ravel())
        common = first[:, often].ravel()
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64), common


def signatures(shingles: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a set: its elements fall into groups of three parts, by hash, and each two parts of a group
    give one signature.

    rank says how common an element is. Those of rank COMMON_RANK are left out on both sides of a pair, which never adds
    a difference. Empty signatures are left out. A group is weak if two of its parts are empty. If one set of a pair has
    at most `spare` weak groups, then of the spare + 1 groups that agree up to one element one isn't weak in it, and its
    signature is shared and not empty. A set with more weak groups also gives the rarest of its elements, as many as two
    similar enough sets share one of, and so finds the other sets of this kind.
    """
    return np.concatenate(_signatures(shingles, rank, percent))


def _describe(n: int, id_type: pa.DataType):
    """Per document its set's size, node and sketch; at the end of a task, how often each slot held a shingle."""
    schema = pa.schema([("id", id_type), ("tkey", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("seg", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        hashes, slots, seen = WordHashes(), np.zeros(1 << SLOT_BITS, np.int32), set()
        for b in small(batches):
            texts, sizes, nodes, sketches = texts_of(b.column(2)), [], [], []
            for text in texts:
                s = shingle_set(text, hashes, n)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
                if len(s) and nodes[-1] not in seen:
                    seen = set() if len(seen) >= _SEEN else seen
                    seen.add(nodes[-1])
                    np.add.at(slots, s >> np.uint64(64 - SLOT_BITS), 1)
            rows = len(texts)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(len, texts), pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema)
        for seg, part in enumerate(np.split(slots, SEGMENTS)):
            if part.any():
                yield pa.record_batch([pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([seg], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], schema=schema)

    return run


def _summed(batches):
    schema = pa.schema([("seg", pa.int32()), ("blob", pa.binary())])
    now, total = None, None
    for b in batches:
        for seg, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
            if seg == now:
                total += part
                continue
            if now is not None:
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total.tobytes()])], schema=schema)
            now, total = seg, part
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total.tobytes()])], schema=schema)


_PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])


def _packed(sig: np.ndarray, node: np.ndarray, hub: np.ndarray, member: np.ndarray, buckets: int):
    """Batches of (bucket, kind, blob): kind 0 has signatures, eight bytes each, with the table of their nodes; kind 1
    pairs of a node and the common element that it belongs to."""
    rows = [(int(hub[i] % np.uint64(buckets)), 1, np.stack([member[i : i + _HUBS], hub[i : i + _HUBS].view(np.int64)], 1).tobytes()) for i in range(0, len(hub), _HUBS)]
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        at = order[ends[k] : ends[k + 1]]
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            names, index = np.unique(node[part], return_inverse=True)
            # 48 bits of the signature, 16 of the place in the table of nodes
            body = (sig[part] & np.uint64(0xFFFFFFFFFFFF0000)) | index.astype(np.uint64)
            rows.append((k, 0, np.r_[np.array([len(names)], np.int64), names, body.view(np.int64)].tobytes()))
        if len(rows) > 256:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACK, strict=True)], schema=_PACK)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACK, strict=True)], schema=_PACK)


def _sign(n: int, percent: int, ranks, buckets: int):
    """Packed signatures of the sets of texts, each set once a task."""

    def run(batches):
        hashes, seen, sigs, hubs, nodes, total = WordHashes(), set(), [], [], [], 0
        rank_of = np.frombuffer(ranks.value, np.uint8)

        def pack():
            ends = [np.repeat(np.array(nodes, np.int64), [len(x) for x in part]) for part in (sigs, hubs)]
            return _packed(np.concatenate(sigs), ends[0], np.concatenate(hubs), ends[1], buckets)

        for b in small(batches):
            for text in texts_of(b.column(0)):
                s = shingle_set(text, hashes, n)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen = set() if len(seen) >= _SEEN else seen
                seen.add(node)
                sig, hub = _signatures(s, rank_of[s >> np.uint64(64 - SLOT_BITS)], percent)
                sigs.append(sig)
                hubs.append(hub)
                nodes.append(node)
                total += len(sig) + 2 * len(hub)
            if total >= PACK:
                yield from pack()
                sigs, hubs, nodes, total = [], [], [], 0
        if total:
            yield from pack()

    return run


def _meet(batches):
    """(node, grp, hub) of each node that shares a signature: its group is named by the first node that has the signature,
    which gets no row itself. hub: the group is that of a common element.

    Equal signatures are in one bucket, so in one task. A group has as many members as documents may hold a shingle that
    isn't common, so a bounded share of a task's; those of common elements, without such a bound, only pass through.
    """
    schema = pa.schema([("node", pa.int64()), ("grp", pa.int64()), ("hub", pa.bool_())])
    part = lambda e, hub: pa.record_batch([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy()), pa.array(np.full(len(e), hub))], schema=schema)
    sigs, nodes = [], []
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(blob, np.int64)
            if kind:
                yield part(x.reshape(-1, 2), True)
                continue
            body = x[1 + x[0] :].view(np.uint64)
            sigs.append(body >> np.uint64(16))
            nodes.append(x[1 : 1 + x[0]][(body & np.uint64(0xFFFF)).astype(np.int64)])
    if not sigs:
        return
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    del sigs, nodes
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    # only signatures of two nodes or more matter from here on; a node signed by several tasks counts once
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    least, most = np.minimum.reduceat(node, first), np.maximum.reduceat(node, first)
    sizes = np.diff(np.r_[first, len(sig)])
    group, kept = np.repeat(least, sizes), np.repeat(least != most, sizes)
    kept &= node != group
    e = np.unique(np.stack([node, group], 1)[kept], axis=0)
    for start in range(0, len(e), 1 << 18):
        yield part(e[start : start + (1 << 18)], False)


def _narrow(percent: int):
    """(node, grp) of the members of a group, or of two blocks of one, that sketches leave a partner there: they are named by
    the least node that such pairs reach."""
    schema = pa.schema([("node", pa.int64()), ("grp", pa.int64())])

    def out(rows):
        if len(rows) < 2:
            return
        linked = may_link(np.array([n for _, n, _ in rows]), [s for _, _, s in rows], percent)
        kept = linked.any(1)
        if kept.any():
            names = np.array([node for node, _, _ in rows])
            roots, _ = _roots(linked, names, None)
            yield pa.record_batch([pa.array(names[kept]), pa.array(roots[kept])], schema=schema)

    def run(batches):
        key, rows = None, []
        for b in small(batches):
            for g, i, j, node, n, bitmap in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (g, i, j) != key:
                    yield from out(rows)
                    key, rows = (g, i, j), []
                rows.append((node, n, np.frombuffer(bitmap, np.uint8)))
        yield from out(rows)

    return run


def _narrowed(found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members (node, grp) of groups, from those found (node, grp, hub), without nodes whose sketch (node, n, sketch) rules
    out all others of the group.

    So strangers that share a passage, whose pairs grow with the square of the documents, aren't compared by their texts. A
    group falls into blocks, and each two of them into a task. Groups of common elements with more than PASS members stay
    as they are: their members hold little but common elements, and are many times alike.
    """
    firsts = found.where("not hub").select(F.col("grp").alias("node"), "grp", "hub").distinct()
    member = cut(found.unionByName(firsts))
    sizes = cut(member.groupBy("grp").agg(F.count("*").alias("often"), F.max("hub").alias("hub")))
    rows = join_skewed(member.select("node", "grp"), sizes, "grp", "often")
    whole = F.col("hub") & (F.col("often") > PASS)
    blocks = F.ceil(F.col("often") / NARROW).cast("int")
    rest = rows.where(~whole & (F.col("often") > 1)).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("k"))
    rest = rest.select("grp", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "node").join(sketches, "node").select("grp", "i", "j", "node", "n", "sketch")
    near = rest.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_narrow(percent), "node long, grp long")
    return cut(near.unionByName(rows.where(whole).select("node", "grp")).distinct())


def _cells(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, cell), and (node, cell, other) where a node meets another cell, from the members (node, grp) of groups.

    A node goes to the cell of the least group within two steps (its groups, their members' groups). So the copies of a
    text come into one cell, but chains of groups don't grow together. Any two members of a group are in one cell, or
    each meets the other's cell; a group that reaches into more than WIDE cells makes them one.
    """
    first = member.groupBy("node").agg(F.min("grp").alias("l"))
    near = cut(member.join(first, "node").groupBy("grp").agg(F.min("l").alias("l"), F.count("*").alias("often")))
    home = cut(join_skewed(member, near, "grp", "often").groupBy("node").agg(F.min("l").alias("cell")))
    reach = member.join(home, "node").select("grp", "cell").distinct()
    many = reach.groupBy("grp").agg(F.count("*").alias("n"), F.min("cell").alias("least")).where("n > 1")
    mixed = cut(reach.join(many, "grp"))
    wide = mixed.where(F.col("n") > WIDE).select(F.col("cell").alias("a"), F.col("least").alias("b"))
    few = mixed.where(F.col("n") <= WIDE).select("grp", "cell")
    if wide.limit(1).count():
        merged = components(wide).select(F.col("node").alias("cell"), "label")
        home = cut(home.join(merged, "cell", "left").select("node", F.coalesce("label", "cell").alias("cell")))
        few = few.join(merged, "cell", "left").select("grp", F.coalesce("label", "cell").alias("cell"))
    others = cut(few.groupBy("grp").agg(F.collect_set("cell").alias("others")).where(F.size("others") > 1))  # WIDE cells at most
    met = member.join(others, "grp").join(home, "node").select("node", "cell", F.explode("others").alias("other"))
    return home, cut(met.where("cell <> other").distinct())


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, by products of 0-1 matrices a slice of the elements at a time."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    every = np.concatenate(left + right)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    number = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((len(left), len(right)), np.float32), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[row[a:z], column[a:z] - start] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total.astype(np.int64)


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The least name that links reach from each row and column of a matrix of links; right: None if both are the same."""
    own, other, most = left, left if right is None else right, np.iinfo(np.int64).max
    while True:
        far = np.minimum(other, np.where(linked, own[:, None], most).min(0)) if right is not None else own
        near = np.minimum(own, np.where(linked, far[None, :], most).min(1))
        if (near == own).all() and (far == other).all():
            return near, far
        own, other = near, far if right is not None else near


def _verify(n: int, percent: int):
    """(node, root, links) of each unit, a block or two blocks of documents: exact links, the least node of each linked
    set, and the rows that a node is linked to."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def judged(alone, rows, hashes):
        sides: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
        for side, node, copies, text in rows:
            if node not in sides[side]:
                sides[side][node] = (copies, shingle_set(text, hashes, n))
        left, right = sides[0], sides[0] if alone else sides[1]
        if not left or not right:
            return None
        sets = [[s for _, s in side.values()] for side in (left, right)]
        inter = _shared(*sets)
        sizes = [np.array([len(s) for s in part]) for part in sets]
        linked = 100 * inter >= percent * (sizes[0][:, None] + sizes[1][None, :] - inter)
        if alone:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        names = [np.fromiter(side, np.int64, len(side)) for side in (left, right)]
        copies = [np.array([c for c, _ in side.values()]) for side in (left, right)]
        roots = _roots(linked, names[0], None if alone else names[1])
        links = [linked @ copies[1], linked.T @ copies[0]]
        found = [np.stack([a, r, k], 1)[k > 0] for a, r, k in zip(names, roots, links, strict=True)][: 1 if alone else 2]
        return np.concatenate(found)

    def run(batches):
        hashes, key, rows = WordHashes(), None, []

        def out():
            found = judged(key[:2] == key[2:], rows, hashes)
            if found is not None:
                yield pa.record_batch([pa.array(found[:, k].copy()) for k in range(3)], schema=schema)

        for b in small(batches):
            columns = [b.column(c).to_pylist() for c in range(7)]
            for c1, i, c2, j, side, node, copies, text in zip(*columns, texts_of(b.column(7)), strict=True):
                if (c1, i, c2, j) != key:
                    if rows:
                        yield from out()
                    key, rows = (c1, i, c2, j), []
                rows.append((side, node, copies, text))
        if rows:
            yield from out()

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose sets of word n-grams have a Jaccard similarity of percent / 100 or more.

    Equal sets are one node. Bands of sizes have a bound on how far two similar sets differ; PartEnum partitions the
    domain of shingles and enumerates pairs of parts, so that any two similar sets of a band share a signature (see
    `signatures`). Shingles that very many documents hold, counted over all of them in a table of 2 ** 20 slots, take no
    part in signatures, which keeps a common passage from joining strangers and loses nothing. Signatures are packed
    before the shuffle; partitions grow in number with the count of shingles, so the signatures of one stay few, and a
    group that shares one names its first member instead of yielding its pairs. Sketches of the sets, which never rule out a
    similar pair, take members that are strangers to all others out of a group (see `_narrowed`). Groups that overlap come into cells (see
    `_cells`), which don't grow along chains; all sets of a cell, and those of two cells that share a group across, are
    compared exactly and once, block against block of about 512 documents, by matrix products. Linked sets are then
    joined into components. Groups and links never reach the driver, and nothing is capped.

    Returns id, n_shingles, component_id (the smallest id reachable over links, itself included) and n_links (rows
    linked, copies included). A document of fewer than n words is one shingle; one without words, or null, has none, no
    link and its own id. Null ids are never the smallest of a group with other ids. Repeated rows count as copies, and bring
    their text once. An empty table gives no rows. Two sets are taken as equal by a 64-bit digest.
    """
    with small_batches(df.sparkSession):
        return _near_duplicates(df, id_col, text_col, n, percent)


def _near_duplicates(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    keyed = docs.select("id", F.xxhash64("text").alias("tkey"), "text")
    described = cut(keyed.mapInArrow(_describe(n, id_type), f"id {id_name}, tkey long, bytes long, n long, node long, sketch binary, seg int, blob binary"))
    rows = described.where("seg is null").drop("seg", "blob", "sketch")
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    width = len(counts) // SEGMENTS
    summed = described.where("seg is not null").select("seg", "blob").repartition("seg").sortWithinPartitions("seg").mapInArrow(_summed, "seg int, blob binary")
    for r in summed.collect():  # SEGMENTS rows, 8 MB in all
        counts[r.seg * width : (r.seg + 1) * width] = np.frombuffer(r.blob, np.int64)
    rank = np.minimum(8 * np.log2(1 + counts), COMMON_RANK - 1).astype(np.uint8)
    # the mean and its root are what strangers bring to a slot, so that a shingle that isn't common is in few documents
    rank[counts > COMMON + counts.mean() + 8 * counts.mean() ** 0.5] = COMMON_RANK
    ranks = spark.sparkContext.broadcast(rank.tobytes())  # one byte a slot
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // MEET + 1)
    signed = docs.select("text").mapInArrow(_sign(n, percent, ranks, 2 * parts), "bucket int, kind byte, blob binary")
    found = cut(signed.repartition(parts, "bucket").mapInArrow(_meet, "node long, grp long, hub boolean").distinct())
    sketches = described.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    home, across = _cells(_narrowed(found, sketches, percent))
    nodes = rows.where("node is not null").groupBy("node", "tkey", "id").agg(F.count("*").alias("rows"), F.min("bytes").alias("bytes"))
    nodes = nodes.groupBy("node").agg(F.min("id").alias("least"), F.sum("rows").alias("copies"), F.min(F.struct("tkey", "id", "bytes", "rows")).alias("at"))
    placed = cut(nodes.join(home, "node").select("node", "least", "copies", "cell", F.col("at.tkey").alias("at_tkey"), F.col("at.id").alias("at_id"), F.col("at.rows").alias("at_rows"), F.col("at.bytes").alias("bytes")))
    judged = cut(_units(keyed, placed, across).mapInArrow(_verify(n, percent), "node long, root long, links long"))
    ranks.unpersist()
    classes = components(judged.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    linked = placed.select("node", "least").join(classes, "node")
    least = cut(linked.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("often")))
    linked = join_skewed(classes, least, "label", "often").join(links, "node").select("node", "component", "links")
    # what isn't so for a single document without links
    known = nodes.select("node", "least", "copies").join(linked, "node", "left").where("copies > 1 or links is not null")
    known = cut(known.select("node", "copies", F.coalesce("component", "least").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    found = join_skewed(rows.select("id", "n", "node"), known, "node", "copies")
    return found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _units(keyed: DataFrame, placed: DataFrame, across: DataFrame) -> DataFrame:
    """(c1, i, c2, j, side, node, copies, text) sorted by unit: block i of the documents of cell c1 is compared with block j
    of those of c2, of all documents if c1 = c2, else of those that meet the other cell."""
    count = lambda docs: F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias(docs)
    block = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    until = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ends = ("node", "copies", "at_tkey", "at_id", "at_rows")
    within = join_skewed(placed, cut(placed.groupBy("cell").agg(F.count("*").alias("docs"), count("blocks"))), "cell", "docs").where("docs > 1")
    within = within.withColumn("block", block("blocks")).select("*", until("blocks").alias("k"))
    within = within.select(F.col("cell").alias("c1"), F.least("block", "k").alias("i"), F.col("cell").alias("c2"), F.greatest("block", "k").alias("j"), (F.col("block") > F.col("k")).cast("int").alias("side"), *ends)
    met = cut(placed.join(across.select("node", "other"), "node"))
    sizes = cut(met.groupBy("cell", "other").agg(count("blocks")))
    met = met.join(sizes, ["cell", "other"]).join(sizes.select(F.col("cell").alias("other"), F.col("other").alias("cell"), F.col("blocks").alias("others")), ["cell", "other"])
    met = met.withColumn("block", block("blocks")).select("*", until("others").alias("k"))
    low = F.col("cell") < F.col("other")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    met = met.select(pick("cell", "other").alias("c1"), pick("block", "k").alias("i"), pick("other", "cell").alias("c2"), pick("k", "block").alias("j"), (~low).cast("int").alias("side"), *ends)
    units = cut(within.unionByName(met))
    # a broadcast of a checked size, else a shuffle of the texts by their own key
    meet = lambda texts, some: texts.join(sent_if_small(some, ROW_BYTES), (F.col("tkey") == F.col("at_tkey")) & F.col("id").eqNullSafe(F.col("at_id")))
    texts = meet(keyed, units.where("at_rows = 1"))
    repeated = units.where("at_rows > 1")
    if repeated.limit(1).count():
        # repeated rows bring their text once
        once = meet(keyed, repeated.select("at_tkey", "at_id").distinct()).groupBy("tkey", "id").agg(F.first("text").alias("text"))
        texts = texts.unionByName(meet(once, repeated))
    return texts.select("c1", "i", "c2", "j", "side", "node", "copies", "text").repartition("c1", "i", "c2", "j").sortWithinPartitions("c1", "i", "c2", "j")
