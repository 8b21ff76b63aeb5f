"""Exact n-gram Jaccard join in metric space.

Jaccard distance is a metric.  Far apart, where whole texts as pivots say nothing (nearly all texts are
at distance 1 from all of them), the pivots are single shingles: a text's nearest pivots are its own
shingles, and of these the one that is rarest in the corpus comes first.  The triangle inequality says
how many of a text's nearest pivots a partner within the threshold must share one of; the text is
replicated to these regions as an entry of some bytes.  Within a region the triangle inequality drops
texts that the threshold forbids: sizes (distance to the empty set) and counts over sixteen parts of
the hash space (distances within each part) bound the distance from below.  What passes connects texts
to clusters, and no link crosses clusters.

Close by, whole texts are pivots.  A cluster's texts are given by their difference from a pivot: those
in the ball around the pivot are linked to it, those beyond the widest window from all others are
joined among themselves with a new pivot, and the rest must share differences, which an index finds.
Every link between different sets is found by exact counts; equal sets are one text from the start.
A wide cluster is joined by many tasks: a few pivots connect the texts in their balls, which then need no
comparison among themselves, and slices of the other texts meet all slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.components import connected_components
from tidemark.llm.shared import collected, session_of, shuffle_partitions, stored
from tidemark.llm.words import STEP, mixed

#: Parts of the hash space whose counts bound distances.
PARTS = 16
#: Elements of the dense matrices that a small cluster is joined with.
DENSE = 4_000_000
#: Regions of up to so many texts are compared pair by pair, all at once.
SMALL = 6
#: A cluster of more texts is wide: it is joined by many tasks, each with two slices of about so many.
WIDE = 256
#: Texts of a wide cluster that all its texts are compared with first.
PIVOTS = 8
#: Texts whose sets go to Spark as one batch.
BATCH = 1024


@dataclass(frozen=True)
class Threshold:
    """Similar means den * intersection >= num * union."""

    num: int
    den: int

    def prefix(self, n: int) -> int:
        """Of n shingles in a fixed order, a partner has one of so many first ones."""
        return n - -(-self.num * n // self.den) + 1

    def sizes(self, a, b):
        """Whether sizes allow a link."""
        return self.num * np.maximum(a, b) <= self.den * np.minimum(a, b)

    def apart(self, difference, total):
        """Whether a symmetric difference is too large for two sets of that total size."""
        return (self.den + self.num) * difference > (self.den - self.num) * total


class Forest:
    """Union-find over numbers from 0."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def shingle_sets(block: B.Block, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; a shorter text is one shingle."""
    words = block.hashes[0]
    lens = np.diff(block.starts)
    out = []
    # Some documents at a time, so that only the sets grow with the block.
    cuts = np.searchsorted(block.starts[:-1], np.arange(0, max(1, len(words)), STEP))
    cuts = np.unique(np.append(cuts, [0, len(lens)])).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        hashes = B.window_hashes(words, B.windows(words, block.starts[a : b + 1], width), width)
        ends = np.cumsum(np.maximum(lens[a:b] - width + 1, 0))
        for d, n in enumerate(lens[a:b].tolist()):
            if n >= width:
                out.append(np.unique(hashes[ends[d] - (n - width + 1) : ends[d]]))
            elif n:
                whole = B.window_hashes(words, block.starts[a + d : a + d + 1], n, lane=1)
                out.append(mixed(whole + np.uint64(n)))
            else:
                out.append(words[:0].copy())
    return out


def _scan(table: DataFrame, width: int) -> DataFrame:
    """(node, id, n, key) of every row; equal keys are equal sets, an empty set has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                sets = shingle_sets(block, width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                nodes = (block.number << B.ROW_BITS) + np.arange(len(sets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(block.ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary())],
                    names=["node", "id", "n", "key"],
                )

    return stored(table.mapInArrow(scan, "node long, id long, n long, key binary"), "sets")


def _asked(sets: list[np.ndarray], mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shortened shingles of a block, sorted, and in how many of its documents each is."""
    flat = np.sort(np.concatenate(sets) & mask)
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    return flat[first], np.diff(np.append(first, len(flat)))


def _frequencies(table: DataFrame, width: int, mask: np.uint64, buckets: int) -> DataFrame:
    """(block, bucket, blob): in how many documents of the corpus each shingle of a block is.

    Shingles are shortened; the few that become equal are counted together, which only makes them look
    more common than they are.
    """
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    rows = lambda v: pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in v], k) for i, k in enumerate(kinds)], names=["block", "bucket", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                keys, counts = _asked(shingle_sets(block, width), mask)
                yield rows([(block.number, b, B.pack_keys(keys[s], counts[s].astype("<u4"))) for b, s in B.cuts(keys, buckets)])

    def total(bucket: pa.Table) -> pa.Table:
        parts = [B.unpack_keys(x, "<u4") for x in bucket.column("blob").to_pylist()]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys)
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(np.concatenate([c for _, c in parts])[order].astype(np.int64), first)
        each = np.empty(len(keys), "<u8")
        each[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        ends = np.cumsum([len(k) for k, _ in parts])
        return pa.Table.from_batches([rows([
            (n, b, B.pack(each[e - len(k) : e])) for n, b, e, (k, _) in zip(
                bucket.column("block").to_pylist(), bucket.column("bucket").to_pylist(), ends, parts, strict=True)])])

    schema = "block long, bucket long, blob binary"
    return stored(table.mapInArrow(send, schema).groupBy("bucket").applyInArrow(total, schema), "frequencies", codec="uncompressed")


def _profile(shingles: np.ndarray) -> np.ndarray:
    """The counts of a set in the parts of the hash space, as two 64-bit integers."""
    counts = np.bincount((shingles >> np.uint64(60)).astype(np.int64), minlength=PARTS)
    return np.minimum(counts, 255).astype(np.uint8).view(np.uint64)


def region_edges(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, profiles: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A forest over the texts of regions (entries of equal keys) that connects all pairs that may be similar."""
    order = np.lexsort((sizes, keys))
    keys, nodes, sizes, profiles = keys[order], nodes[order], sizes[order], profiles[order]
    names, index = np.unique(nodes, return_inverse=True)
    forest, out = Forest(len(names)), []

    def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        good = t.sizes(sizes[i], sizes[j])
        bound = np.abs(profiles[i].astype(np.int64) - profiles[j]).sum(axis=-1)
        return good & ~t.apart(bound, sizes[i] + sizes[j])

    def link(i: int, j: int) -> None:
        if forest.join(int(index[i]), int(index[j])):
            out.append((int(nodes[i]), int(nodes[j])))

    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    count = np.diff([*first, len(keys)])
    size_of = np.repeat(count, count)
    last = np.repeat(first + count, count)
    for step in range(1, SMALL):
        i = np.flatnonzero((size_of <= SMALL) & (np.arange(len(keys)) + step < last))
        i = i[near(i, i + step)]
        for a, b in zip(i.tolist(), (i + step).tolist(), strict=True):
            link(a, b)
    for begin, n in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
        # Each text, once reached, looks for those not yet reached, within its window of sizes.
        left = np.arange(begin, begin + n)
        while len(left):
            front, left = [int(left[0])], left[1:]
            while front and len(left):
                i = front.pop()
                low = np.searchsorted(sizes[left], -(-t.num * sizes[i] // t.den))
                high = np.searchsorted(sizes[left], t.den * sizes[i] // t.num, side="right")
                window = left[low:high]
                good = near(i, window)
                for j in window[good].tolist():
                    link(i, j)
                    front.append(j)
                left = np.concatenate([left[:low], window[~good], left[high:]])
    return out


def _dense(sets: list[np.ndarray], sizes: np.ndarray, codes: np.ndarray, universe: int, t: Threshold) -> list[tuple[int, int]]:
    matrix = np.zeros((len(sets), universe), np.float32)
    matrix[np.repeat(np.arange(len(sets)), sizes), codes] = 1
    both = np.rint(matrix @ matrix.T).astype(np.int64)
    total = sizes[:, None] + sizes
    linked = ~t.apart(total - 2 * both, total)
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True))


def cluster_links(sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Links between the sets, enough to connect all that are similar directly or over others."""
    out, todo = [], [np.arange(len(sets))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        part = [sets[i] for i in own]
        sizes = np.array([len(s) for s in part], np.int64)
        flat, codes, counts = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        if len(part) * max(len(part), len(flat)) <= DENSE:
            out += [(int(own[i]), int(own[j])) for i, j in _dense(part, sizes, codes, len(flat), t)]
            continue
        begins = np.cumsum(sizes) - sizes
        pivot = int(np.argmax(np.add.reduceat(counts[codes], begins) / sizes))
        inside = np.zeros(len(flat), bool)
        inside[codes[begins[pivot] : begins[pivot] + sizes[pivot]]] = True
        shared = np.add.reduceat(inside[codes].astype(np.int64), begins)
        difference = sizes + sizes[pivot] - 2 * shared
        ball = ~t.apart(difference, sizes + sizes[pivot])
        out += [(int(own[pivot]), int(own[i])) for i in np.flatnonzero(ball) if i != pivot]
        # Distances to the pivot differ by no more than the distance, which the threshold bounds.
        order = np.argsort(difference, kind="stable")
        steps = np.diff(difference[order])
        widest = (t.den - t.num) * 2 * int(sizes.max()) // (t.den + t.num)
        gap = np.flatnonzero((steps > widest) & ~ball[order][1:])
        near = order if not len(gap) else order[: gap[0] + 1]
        if len(gap):
            todo.append(own[order[gap[0] + 1 :]])
        # A text outside of the ball shares a difference with each text that it is linked to.
        rank = np.full(len(part), -1)
        rank[near] = np.arange(len(near))
        document = np.repeat(np.arange(len(part)), sizes)
        extra = ~inside[codes] & (rank[document] >= 0)
        pairs = [np.stack([rank[document[extra]], codes[extra]], axis=1)]
        core = np.flatnonzero(inside)
        for i in near:
            have = codes[begins[i] : begins[i] + sizes[i]]
            missing = np.setdiff1d(core, have, assume_unique=True)
            pairs.append(np.stack([np.full(len(missing), rank[i]), missing], axis=1))
        table = np.concatenate(pairs)
        table = table[np.argsort(table[:, 1], kind="stable")]
        at = np.searchsorted(table[:, 1], np.arange(len(flat) + 1))
        by_text = table[np.argsort(table[:, 0], kind="stable")]
        rows = np.searchsorted(by_text[:, 0], np.arange(len(near) + 1))
        amount, total = difference[near], sizes[near]
        for r in np.flatnonzero(~ball[near]):
            elements = by_text[rows[r] : rows[r + 1], 1]
            meet = np.concatenate([table[at[e] : at[e + 1], 0] for e in elements] or [np.empty(0, np.int64)])
            common = np.bincount(meet, minlength=len(near))
            good = (common > 0) & ~t.apart(amount[r] + amount - 2 * common, total[r] + total)
            good[r] = False
            out += [(int(own[near[r]]), int(own[near[k]])) for k in np.flatnonzero(good)]
    return out


EDGE = "a long, b long"


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"]
    )


def _by_block(nodes: DataFrame, *more: str) -> DataFrame:
    """(block, asked): the places in each block, with more columns; bounded by the block."""
    place = F.col("node").bitwiseAND((1 << B.ROW_BITS) - 1).cast("int").alias("place")
    return nodes.groupBy(F.shiftright("node", B.ROW_BITS).alias("block")).agg(
        F.collect_list(F.struct(place, *more)).alias("asked")
    )


def _candidate_edges(table: DataFrame, nodes: DataFrame, width: int, t: Threshold, buckets: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that may be similar.

    A text's pivots are ordered from the rarest shingle of the corpus to the most common one.  Those that
    no other text has make no region and are not sent.
    """
    mask = B.key_mask(table)
    counts = _frequencies(table, width, mask, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                sets = shingle_sets(block, width)
                known, _ = _asked(sets, mask)
                common = [B.unpack(a["blob"], "<u8")[0] for a in sorted(row["answers0"] or (), key=lambda a: a["bucket"])]
                common = np.concatenate(common) if common else np.empty(0, np.uint64)
                keys, nodes, sizes, profiles = [], [], [], []
                for place in sorted(a["place"] for a in row["asked"]):
                    own = sets[place]
                    rare = common[np.searchsorted(known, own & mask)]
                    first = np.lexsort((own, rare))[: t.prefix(len(own))]
                    first = own[first[rare[first] > 1]] & mask
                    keys.append(first)
                    nodes.append(np.full(len(first), (block.number << B.ROW_BITS) + place))
                    sizes.append(np.full(len(first), len(own), np.uint32))
                    profiles.append(np.tile(_profile(own), (len(first), 1)))
                keys, nodes, sizes, profiles = (np.concatenate(x) for x in (keys, nodes, sizes, profiles))
                order = np.argsort(keys, kind="stable")
                keys, nodes, sizes, profiles = keys[order], nodes[order], sizes[order], profiles[order]
                rows = [(b, B.pack_keys(keys[s], nodes[s], sizes[s], profiles[s, 0], profiles[s, 1]))
                        for b, s in B.cuts(keys, buckets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["bucket", "blob"],
                )

    def regions(bucket: pa.Table) -> pa.Table:
        parts = [B.unpack_keys(x, "<i8", "<u4", "<u8", "<u8") for x in bucket.column("blob").to_pylist()]
        keys, nodes, sizes, one, two = (np.concatenate([p[i] for p in parts]) for i in range(5))
        # A shingle that one text alone has makes no region.
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        kept = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        profiles = np.stack([one[kept], two[kept]], axis=1).view(np.uint8)
        found = region_edges(keys[kept], nodes[kept], sizes[kept].astype(np.int64), profiles, t)
        return pa.Table.from_batches([_edges(found)])

    sent = B.joined(B.with_answers(table, counts), _by_block(nodes)).mapInArrow(send, "bucket long, blob binary")
    return sent.groupBy("bucket").applyInArrow(regions, EDGE)


def _pivot_links(table: DataFrame, members: DataFrame, width: int, t: Threshold) -> DataFrame:
    """Edges (a, b) between the texts of wide clusters (node, component) and the pivots of their cluster."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                sets = shingle_sets(block, width)
                yield from _set_rows(block, sets, row["asked"], "component")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                sets = shingle_sets(block, width)
                pivots: dict[int, list] = {}
                for p in row["pivots"]:
                    pivots.setdefault(p["component"], []).append((p["node"], np.frombuffer(p["shingles"], np.uint64)))
                out = []
                for asked in row["asked"]:
                    own, node = sets[asked["place"]], (block.number << B.ROW_BITS) + asked["place"]
                    for pivot, other in pivots[asked["component"]]:
                        total = len(own) + len(other)
                        if pivot != node and t.sizes(len(own), len(other)):
                            common = len(np.intersect1d(own, other, assume_unique=True))
                            if not t.apart(total - 2 * common, total):
                                out.append((pivot, node))
                yield _edges(out)

    salt = F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("salt")
    chosen = members.groupBy("component", salt).agg(F.min("node").alias("node"))
    sets = B.joined(table, _by_block(chosen, "component")).mapInArrow(take, "component long, node long, shingles binary")
    sets = stored(sets, "pivots")
    block = F.shiftright("node", B.ROW_BITS).alias("block")
    # A block gets the pivots of the clusters that it has texts of.
    near = members.select(block, "component").distinct().join(sets, "component")
    near = near.groupBy("block").agg(F.collect_list(F.struct("component", "node", "shingles")).alias("pivots"))
    return B.joined(B.joined(table, _by_block(members, "component")), near).mapInArrow(star, EDGE)


def _slices(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component, low, high): the pairs of slices in which the texts of wide clusters meet.

    The largest part of a cluster that pivots have connected needs no comparison within itself; the other
    texts meet it and each other.  Each slice has about WIDE texts.
    """
    own = members.join(found.withColumnRenamed("component", "part"), "node", "left")
    sizes = own.where("part is not null").groupBy("component", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("n", "part")).alias("m"))
    all_texts = members.groupBy("component").agg(F.count("*").alias("texts"))
    size = all_texts.join(largest, "component", "left").select(
        "component", F.col("m.part").alias("core"),
        F.ceil(F.coalesce("m.n", F.lit(0)) / WIDE).alias("cores"),
        F.ceil((F.col("texts") - F.coalesce("m.n", F.lit(0))) / WIDE).alias("rests"),
    )
    # Stored for the same reason as the best rows of components: a wide cluster's texts may be split.
    rows = own.join(stored(size, "wide-sizes"), "component").withColumn("inner", F.coalesce(F.col("part") == F.col("core"), F.lit(False)))
    hashed = F.xxhash64("node")
    rows = rows.where("rests > 0").withColumn(
        "slice", F.when(F.col("inner"), F.col("rests") + F.pmod(hashed, F.col("cores"))).otherwise(F.pmod(hashed, F.col("rests")))
    )
    # A text outside of the core meets all slices, one of the core meets those outside of it.
    last = F.when(F.col("inner"), F.col("rests")).otherwise(F.col("rests") + F.col("cores")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.where("slice <> other or rests + cores = 1")
    return rows.select("node", "component", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"))


def _set_rows(block: B.Block, sets: list[np.ndarray], asked: list[dict], *names: str) -> Iterator[pa.RecordBatch]:
    """The asked places as rows: these names, node, shingles."""
    for at in range(0, len(asked), BATCH):
        part = asked[at : at + BATCH]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([a[x] for a in part], pa.int64()) for x in names),
             pa.array([(block.number << B.ROW_BITS) + a["place"] for a in part], pa.int64()),
             pa.array([sets[a["place"]].tobytes() for a in part], pa.binary())],
            names=[*names, "node", "shingles"],
        )


def _links(table: DataFrame, clusters: DataFrame, width: int, t: Threshold, tasks: int) -> DataFrame:
    """Edges (a, b) that connect the similar nodes of each cluster (node, component).

    A cluster of up to WIDE texts is joined in one place.  A wide one is compared with some pivots first,
    and slices of it meet in pairs, so that no task grows with a cluster.
    """
    wide = clusters.groupBy("component").agg(F.count("*").alias("texts")).where(F.col("texts") > WIDE)
    wide = stored(wide.select("component"), "wide-clusters")
    members = stored(clusters.join(wide, "component").select("node", "component"), "wide-members")
    pivots = stored(_pivot_links(table, members, width, t), "pivot-links")
    pairs = _slices(members, connected_components(pivots))
    plain = clusters.join(wide, "component", "left_anti")
    none = F.lit(0).cast("long")
    pairs = plain.select("node", "component", none.alias("low"), none.alias("high")).unionByName(pairs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True, lanes=1)
                yield from _set_rows(block, shingle_sets(block, width), row["asked"], "component", "low", "high")

    def join(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        names = [group.column(x).to_numpy() for x in ("component", "low", "high")]
        order = np.lexsort((node, *names))
        new = np.any([np.diff(x[order]) != 0 for x in names], axis=0)
        first = np.flatnonzero(np.concatenate([[True], new]))
        out = []
        for a, b in zip(first, [*first[1:], len(order)], strict=True):
            rows = order[a:b]
            sets = [np.frombuffer(group.column("shingles")[i].as_py(), np.uint64) for i in rows.tolist()]
            forest = Forest(len(sets))
            out += [(int(node[rows[i]]), int(node[rows[j]])) for i, j in cluster_links(sets, t) if forest.join(i, j)]
        return pa.Table.from_batches([_edges(out)])

    sent = B.joined(table, _by_block(pairs, "component", "low", "high"))
    sent = sent.mapInArrow(send, "component long, low long, high long, node long, shingles binary")
    part = F.pmod(F.xxhash64("component", "low", "high"), F.lit(tasks)).alias("part")
    return sent.groupBy(part).applyInArrow(join, EDGE).unionByName(pivots)


def _components(table: DataFrame, width: int, t: Threshold) -> DataFrame:
    """(node, id, n, best): every row of the blocks, and the first row (null, id, node) of its component."""
    buckets = B.bucket_count(table)
    rows = _scan(table, width)
    # Equal sets are one node, that of their first row.
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "node"))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("node").alias("node"), least.alias("least"))
    classes = stored(classes, "classes")
    edges = _candidate_edges(table, classes.select("node"), width, t, buckets)
    clusters = stored(connected_components(edges), "clusters")
    collected(session_of(table))
    tasks = max(buckets, 4 * shuffle_partitions(session_of(table)))
    links = connected_components(_links(table, clusters, width, t, tasks))
    roots = classes.join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # Stored, so that both sides of the join come straight from a shuffle and Spark splits a large component's.
    best = stored(roots.groupBy("root").agg(F.min("least").alias("best")), "best")
    known = roots.join(best, "root").select("key", "best")
    return rows.join(known, "key", "left").select("node", "id", "n", "best")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       num: int = 4, den: int = 5, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set are its distinct shingles of
    width words, or all its words as one shingle if it has fewer.  Two texts are linked when den times
    the intersection is num times the union at least; component_id is the least id that links reach.
    Null and empty texts have no shingles and no links, their component is their own id.  A null id
    counts as no id for component_id; repeated rows are copies of each other.  Ids are
    integers, or texts that Spark casts to long; other texts are an error.  Other columns are not read; an empty
    table gives an empty result.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes)
    found = _components(table, width, Threshold(num, den))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("best.id", "id").alias("component_id")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                        num: int = 4, den: int = 5, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without those that are linked to a row that stays.

    Of each component of :func:`similar_components` the row of the least id stays, of several such rows
    the first in the table; rows without shingles all stay.  Ids are integers or can be cast to long.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes, whole=True)
    found = _components(table, width, Threshold(num, den))
    kept = found.where(F.col("best").isNull() | (F.col("best.node") == F.col("node")))
    return B.rows_kept(table, _by_block(kept), docs, text_col)
