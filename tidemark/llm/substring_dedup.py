"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the documents before it (those of smaller ids), the reference.  The
reference is indexed by blocks of the corpus: each block sends its windows' anchors, the least of the
7-word hashes in each 13-word window, to the buckets of a hash space.  Anchors of one document alone
can't begin a factor.  The windows that are left are looked up by 128-bit hashes, and the answer is the
place of the first document that has them.

From these places a match is extended: to both sides as far as the words of the document and of the
reference are the same, which the reference's block finds out by comparing them.  The parse is greedy: at each
word of a document the longest match of the index is cut as a factor, and the next one begins behind it.
A factor's words are removed; so are those of the windows across a boundary of factors that the index has,
as no factor has them whole.

Rows that Spark shuffles are packed by block and bucket; a passage that is everywhere sends one entry
from each block.  Extensions go from block to block, a block that very many ask is answered by several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.shared import stored

WIDTH = 13
GRAM = 7

ANSWER = "block long, bucket long, blob binary"
FACTOR = "array<struct<start:int,length:int,source:long>>"
ASK = "asker long, block long, runs binary, lens binary, words binary, size long"
#: Bytes of the words that one task compares with a block of the reference, about.
ASK_BYTES = 16 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "bucket", "blob"]
    )


def _anchors(block: B.Block, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchors, both lanes of word hashes): the places of windows, and the anchor of each."""
    lanes, first = block.hashes, block.hashes[0]
    grams = np.full(len(first), np.iinfo(np.uint64).max, np.uint64)
    at = B.windows(first, block.starts, gram)
    grams[at] = B.window_hashes(first, at, gram)
    places = B.windows(first, block.starts, width)
    least = grams[places]
    for j in range(1, width - gram + 1):
        np.minimum(least, grams[places + j], out=least)
    return places, least, lanes


def _grouped(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins along the sort order."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _asked(block: B.Block, answers: list | None, width: int, gram: int):
    """What a block looks up: (places, group of each place, first hash, second hash, least id, its first place, last id).

    Groups are distinct windows, sorted by their hashes; computed twice, they come out the same.
    """
    places, anchors, lanes = _anchors(block, width, gram)
    known = [B.unpack_keys(a["blob"])[0] for a in sorted(answers or [], key=lambda a: a["bucket"])]
    known = np.concatenate(known) if known else np.empty(0, np.uint64)
    if len(known) and len(places):
        at = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
        places = places[known[at] == anchors]
    else:
        places = places[:0]
    one = B.window_hashes(lanes[0], places, width, 0)
    two = B.window_hashes(lanes[1], places, width, 1)
    ids = block.order[block.document[places]]
    order = np.lexsort((ids, two, one))
    first = _grouped(order, one, two)
    group = np.empty(len(places), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff([*first, len(order)]))
    ids = ids[order]
    last = np.maximum.reduceat(ids, first) if len(first) else ids
    return places, group, one[order][first], two[order][first], ids[first], places[order][first], last


@dataclass
class Runs:
    """The windows of a block that the index has, as runs that follow each other in one place of the reference.

    A stretch is a sequence of such windows without a gap, begin its first word and end the word after its last
    one.  A run starts at a word, belongs to a stretch and has a place in a block of the reference; back and
    length say how far its match goes, from the start to the left and to the right.
    """

    found: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    stretch: np.ndarray
    start: np.ndarray
    source: np.ndarray
    block: np.ndarray
    place: np.ndarray
    back: np.ndarray
    length: np.ndarray


def _runs(block: B.Block, row: dict, width: int, gram: int, buckets: int) -> Runs:
    places, group, one, *_ = _asked(block, row["answers0"], width, gram)
    source = np.full(len(one), B.LAST, np.int64)
    where, place = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    at = {b: s.start for b, s in B.cuts(one, buckets)}
    for answer in row["answers1"] or ():
        later, ids, numbers, words = B.unpack(answer["blob"], "<i4", "<i8", "<i8", "<u4")
        own = at[answer["bucket"]] + later
        source[own], where[own], place[own] = ids, numbers, words
    document = block.document
    again = source[group] < block.order[document[places]]
    places, group = places[again], group[again]
    source, where, place, owner = source[group], where[group], place[group], document[places]
    gap = np.ones(len(places), bool)
    gap[1:] = (np.diff(places) != 1) | (np.diff(owner) != 0)
    new = gap.copy()
    new[1:] |= (np.diff(where) != 0) | (np.diff(place) != 1)
    first, starts = np.flatnonzero(gap), np.flatnonzero(new)
    found = np.zeros(block.hashes.shape[1] + width + 1, bool)
    found[places] = True
    ends = places[np.append(first[1:], len(places))[: len(first)] - 1] + width if len(first) else first
    return Runs(found, places[first], ends, (np.cumsum(gap) - 1)[starts], places[starts], source[starts], where[starts], place[starts],
                np.zeros(len(starts), np.int64), np.diff(np.append(starts, len(places))) + width - 1)


def _open_runs(runs: Runs) -> np.ndarray:
    """The runs of stretches that have several: only their matches may go on beside the run itself."""
    many = np.bincount(runs.stretch, minlength=len(runs.begin)) > 1
    return np.flatnonzero(many[runs.stretch])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are the same; compared in growing pieces, so that a short run costs little in a long text."""
    n = min(len(a), len(b))
    at, size = 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + size)] != b[at : min(n, at + size)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, 2 * size
    return n


def greedy_factors(begin: int, end: int, start: np.ndarray, back: np.ndarray, length: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The factors (start, length, run) of a stretch: at each word the match that goes furthest, cut where it ends.

    The runs are in order of their starts.  Words at the end of the stretch that are too few for a factor are left.
    """
    low, high = start - back, start + length
    order = np.argsort(low, kind="stable")
    out, heap, k, at = [], [], 0, begin
    while at + width <= end:
        while k < len(order) and low[order[k]] <= at:
            run = int(order[k])
            heapq.heappush(heap, (-int(high[run]), run))
            k += 1
        furthest, run = heap[0]
        out.append((at, -furthest - at, run))
        at = -furthest
    return out


def removed_words(found: np.ndarray, factors: list[tuple[int, int]], width: int) -> np.ndarray:
    """Whether each word goes: those of factors (start, length) of width words at least, and of found windows across a factor's end."""
    covered = np.zeros(len(found) + 1, np.int64)
    for start, length in factors:
        if length >= width:
            covered[start] += 1
            covered[start + length] -= 1
        # No factor has the windows that begin in this one and end behind it.
        low = max(start, start + length - width + 1)
        for w in (np.flatnonzero(found[low : start + length]) + low).tolist():
            covered[w] += 1
            covered[w + width] -= 1
    return np.cumsum(covered)[: len(found)] > 0


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                      gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, factors (start, length, source id), text without them.

    A word goes if a window of width words over it also begins in a document of a smaller id, judged on
    the input.  Rows that repeat an id are no sources for each other; a null id is after all others.
    Null, empty and shorter texts lose nothing; kept words are joined by one space.  Ids are
    integers, or texts that Spark casts to long; other texts are an error.  Other columns are not read, and an
    empty table gives an empty result.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes)
    buckets = B.bucket_count(table)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row)
                places, anchors, _ = _anchors(block, width, gram)
                ids = block.order[block.document[places]]
                if len(anchors):
                    # Neighbouring windows mostly share their anchor.
                    change = np.ones(len(anchors), bool)
                    change[1:] = (anchors[1:] != anchors[:-1]) | (ids[1:] != ids[:-1])
                    anchors, ids = anchors[change], ids[change]
                order = np.argsort(anchors, kind="stable")
                first = _grouped(order, anchors)
                keys, ids = anchors[order][first], ids[order]
                many = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) if len(first) else ids
                many = many.astype(np.uint8)
                yield _batch([(block.number, b, B.pack_keys(keys[s], many[s])) for b, s in B.cuts(keys, buckets)])

    def shared_anchors(bucket: pa.Table) -> pa.Table:
        """The anchors that more than one document has, for each block that asked."""
        parts = [B.unpack_keys(x, "u1") for x in bucket.column("blob").to_pylist()]
        keys, many = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        first = _grouped(order, keys)
        several = (np.diff([*first, len(order)]) > 1) | (np.maximum.reduceat(many[order], first) > 0)
        shared = np.empty(len(keys), bool)
        shared[order] = np.repeat(several, np.diff([*first, len(order)]))
        rows, at = [], 0
        for number, b, (own, _) in zip(bucket.column("block").to_pylist(), bucket.column("bucket").to_pylist(), parts,
                                       strict=True):
            good = own[shared[at : at + len(own)]]
            at += len(own)
            if len(good):
                rows.append((number, b, B.pack_keys(good)))
        return pa.Table.from_batches([_batch(rows)])

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                if row["answers0"]:
                    block = B.read_block(row)
                    _, _, one, two, least, place, last = _asked(block, row["answers0"], width, gram)
                    yield _batch([(block.number, b, B.pack_keys(one[s], two[s], least[s], last[s], place[s].astype("<u4")))
                                  for b, s in B.cuts(one, buckets)])

    def first_documents(bucket: pa.Table) -> pa.Table:
        """The first document of each window and its place, for each block that has it in a later document."""
        parts = [B.unpack_keys(x, "<u8", "<i8", "<i8", "<u4") for x in bucket.column("blob").to_pylist()]
        one, two, least, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
        number = np.repeat(bucket.column("block").to_numpy(), [len(p[0]) for p in parts])
        order = np.lexsort((number, least, two, one))
        first = _grouped(order, one, two)
        source = np.empty(len(one), np.int64)
        source[order] = np.repeat(order[first], np.diff([*first, len(order)]))
        rows, at = [], 0
        for asker, b, part in zip(bucket.column("block").to_pylist(), bucket.column("bucket").to_pylist(), parts, strict=True):
            own = source[at : at + len(part[0])]
            at += len(own)
            later = np.flatnonzero(least[own] < part[3])
            own = own[later]
            if len(later):
                rows.append((asker, b, B.pack(later.astype("<i4"), least[own], number[own], place[own])))
        return pa.Table.from_batches([_batch(rows)])

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches with several runs, to the blocks of the reference in which their runs are."""
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        for batch in batches:
            for row in B.rows_of(batch):
                if not row["answers1"]:
                    continue
                block = B.read_block(row)
                runs = _runs(block, row, width, gram, buckets)
                asked = _open_runs(runs)
                for number in np.unique(runs.block[asked]).tolist():
                    own = asked[runs.block[asked] == number]
                    stretches, which = np.unique(runs.stretch[own], return_inverse=True)
                    words = np.concatenate([block.hashes[0, runs.begin[k] : runs.end[k]] for k in stretches]).tobytes()
                    blob = B.pack(own.astype("<i4"), runs.place[own].astype("<u4"), (runs.start[own] - runs.begin[runs.stretch[own]]).astype("<u4"),
                                  which.astype("<i4"))
                    lens = (runs.end[stretches] - runs.begin[stretches]).astype("<i4").tobytes()
                    values = (block.number, number, blob, lens, words, len(words))
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                                     names=["asker", "block", "runs", "lens", "words", "size"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far each asked run goes on to both sides in this block of the reference, within its document."""
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lanes=1)
                words, starts = block.hashes[0], block.starts
                for ask in row["asks"]:
                    own, place, offset, which = (x.astype(np.int64) for x in B.unpack(ask["runs"], "<i4", "<u4", "<u4", "<i4"))
                    ends = np.cumsum(np.frombuffer(ask["lens"], "<i4").astype(np.int64))
                    theirs = np.split(np.frombuffer(ask["words"], "<u8"), ends[:-1])
                    of = np.searchsorted(starts, place, side="right") - 1
                    back, length = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
                    for i, (p, o, w, d) in enumerate(zip(place, offset, which, of, strict=True)):
                        length[i] = _common(theirs[w][o:], words[p : starts[d + 1]])
                        back[i] = _common(theirs[w][:o][::-1], words[starts[d] : p][::-1])
                    yield _batch([(ask["asker"], block.number, B.pack(own.astype("<i4"), back, length))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())])
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row)
                document = block.document
                gone = np.zeros(block.hashes.shape[1], bool)
                factors: list[list[dict]] = [[] for _ in block.ids]
                if row["answers1"]:
                    runs = _runs(block, row, width, gram, buckets)
                    for answer in row["answers2"] or ():
                        own, back, length = B.unpack(answer["blob"], "<i4", "<u4", "<u4")
                        runs.back[own], runs.length[own] = back, length
                    cut = []
                    bounds = np.searchsorted(runs.stretch, np.arange(len(runs.begin) + 1)).tolist()
                    for k, (begin, end) in enumerate(zip(runs.begin.tolist(), runs.end.tolist(), strict=True)):
                        own = slice(bounds[k], bounds[k + 1])
                        cut += [(s, n, run + own.start) for s, n, run in greedy_factors(
                            begin, end, runs.start[own], runs.back[own], runs.length[own], width)]
                    for s, n, run in cut:
                        d = document[s]
                        factors[d].append({"start": int(s - block.starts[d]), "length": n, "source": int(runs.source[run])})
                    gone = removed_words(runs.found, [(s, n) for s, n, _ in cut], width)[: len(gone)]
                removed = np.bincount(document[gone], minlength=len(block.ids))
                kept = []
                for d, text in enumerate(B.texts_of(row)):
                    words = text.split()
                    if removed[d]:
                        keep = ~gone[block.starts[d] : block.starts[d + 1]]
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array(np.diff(block.starts)), pa.array(removed.astype(np.int64)),
                     pa.array(factors, pa.list_(factor)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "factors", "text"],
                )

    sent = table.mapInArrow(send_anchors, ANSWER)
    shared = stored(sent.groupBy("bucket").applyInArrow(shared_anchors, ANSWER), "anchors", codec="uncompressed")
    asked = B.with_answers(table, shared).mapInArrow(send_windows, ANSWER)
    sources = stored(asked.groupBy("bucket").applyInArrow(first_documents, ANSWER), "sources", codec="uncompressed")
    asks = stored(B.with_answers(table, shared, sources).mapInArrow(send_runs, ASK), "runs", codec="uncompressed")
    # A block of the reference that very many ask is there once for each ASK_BYTES of what they ask.
    shares = asks.groupBy("block").agg(F.ceil(F.sum("size") / ASK_BYTES).alias("shares"))
    share = F.pmod(F.xxhash64("asker"), F.col("shares")).alias("share")
    by_share = asks.join(shares, "block").select("block", share, F.struct("asker", "runs", "lens", "words").alias("ask"))
    # Dealt by both before they are gathered; a block alone would do for Spark, and bring all shares of it to one task.
    by_share = by_share.repartition("block", "share").groupBy("block", "share").agg(F.collect_list("ask").alias("asks"))
    reference = table.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    extended = reference.join(by_share.hint("merge"), ["block", "share"]).mapInArrow(extend, ANSWER)
    out = B.with_answers(table, shared, sources, stored(extended, "extensions", codec="uncompressed")).mapInArrow(
        parse, f"id long, n_words long, n_removed long, factors {FACTOR}, text string"
    )
    return out.withColumnRenamed("id", id_col)
