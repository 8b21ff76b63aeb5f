"""Texts in packed blocks, and exchanges of sorted keys between blocks and buckets.

Several operators ask something about every word window or shingle of the corpus.  A row for each
would cost Spark more than the question is worth, so rows here are packed: a *block* has some MB of
whole documents, and what it asks goes out as one blob for each *bucket* of a hash space.  Spark
shuffles the blobs by bucket, a bucket's task answers all blocks, and the answers are shuffled back
by block.  A key that is everywhere sends one entry from each block, however often it occurs there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import session_of, shuffle_partitions, stored, text_of
from tidemark.llm.words import STEP, mixed, word_hashes, word_spans

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose keys make one bucket, on average.
BUCKET_BYTES = 4 << 20
#: A shortened key has so many bits more than the size of the corpus in bytes.
SPARE_BITS = 18
#: The place of rows without an id in the order of ids.
LAST = np.iinfo(np.int64).max

#: A block has fewer documents than two to this power, and a partition fewer blocks, so that a row of
#: the corpus is known by one integer: ``block << ROW_BITS | place in the block``.
ROW_BITS = 20

BLOCK_SCHEMA = "block long, ids array<long>, sizes binary, size long, text binary, rest binary"


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                whole: bool = False) -> DataFrame:
    """The documents as a stored table of blocks: their ids, byte lengths and compressed texts.

    Being stored, a block keeps its number whatever is computed again.  If whole is set, rest has the
    other columns too, for :func:`rows_kept`.
    """
    others = [c for c in docs.columns if c != text_col] if whole else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << ROW_BITS
        ids, texts, size, rest = [], [], 0, []

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in texts], np.int64)
            packed = zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()),
                 pa.array([size], pa.int64()), pa.array([packed], pa.binary()),
                 pa.array([_ipc(rest) if rest else None], pa.binary())],
                names=["block", "ids", "sizes", "size", "text", "rest"],
            )

        for batch in batches:
            begin = 0
            more = batch.select(range(2, batch.num_columns))
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if texts and (size + len(text) > block_bytes or len(texts) + 1 >> ROW_BITS):
                    rest += [more.slice(begin, i - begin)] * whole
                    yield row()
                    number, ids, texts, size, rest, begin = number + 1, [], [], 0, [], i
                ids.append(batch.column("id")[i].as_py())
                texts.append(text)
                size += len(text)
            rest += [more.slice(begin)] * whole
        if texts:
            yield row()

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"),
        *(F.col(text_col).isNull().alias("none") for _ in range(whole)),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)),
    )
    return stored(rows.mapInArrow(scan, BLOCK_SCHEMA), "blocks", codec="uncompressed")


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_kept(blocks: DataFrame, asked: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all columns of like, that asked (block, asked: places) names in whole blocks."""
    others = [c for c in like.columns if c != text_col]
    names, width = like.columns, len(others)
    order = [width if c == text_col else others.index(c) for c in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                places = np.array(sorted(a["place"] for a in row["asked"]))
                texts = texts_of(row)
                none = rest.column("none").to_pylist()
                kept = pa.array([None if none[p] else texts[p] for p in places], pa.binary()).cast(pa.string())
                columns = [rest.column(f"c{i}").take(pa.array(places)) for i in range(width)] + [kept]
                table = pa.Table.from_arrays([columns[i] for i in order], names=names)
                yield from table.combine_chunks().to_batches()

    return joined(blocks, asked).mapInArrow(scan, like.schema)


def texts_of(row: dict, lower: bool = False) -> list[bytes]:
    """The texts of a block row."""
    sizes, raw = _raw(row, lower)
    ends = np.cumsum(sizes + 1) - 1
    return [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def _raw(row: dict, lower: bool) -> tuple[np.ndarray, bytes]:
    """(byte lengths of the texts, the texts with a line end between each two)."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    most = int(row["size"]) + len(sizes)
    raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, most))
    return sizes, raw.lower() if lower else raw


def bucket_count(blocks: DataFrame) -> int:
    """So many buckets that one has the keys of about BUCKET_BYTES of text."""
    size = blocks.agg(F.sum("size")).first()[0] or 0
    return max(shuffle_partitions(session_of(blocks)), -(-size // BUCKET_BYTES))


@dataclass
class Block:
    """A block's documents as hashed words: document d has hashes[:, starts[d] : starts[d + 1]]."""

    number: int
    ids: list[int | None]
    order: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray

    @property
    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


def read_block(row: dict, lower: bool = False, lanes: int = 2) -> Block:
    """A block row as hashed words: what stands between ASCII white space, A-Z in lower case on wish."""
    sizes, raw = _raw(row, lower)
    begin, end = word_spans(raw)
    # Texts are one byte apart, and that byte is white space.
    starts = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes + 1)]))
    ids = row["ids"]
    order = np.array([LAST if i is None else i for i in ids], np.int64)
    return Block(row["block"], ids, order, starts, word_hashes(raw, begin, end, lanes))


def key_mask(blocks: DataFrame) -> np.uint64:
    """The bits of a 64-bit hash that keys keep: SPARE_BITS more than the size of the corpus has."""
    size = blocks.agg(F.sum("size")).first()[0] or 1
    bits = min(63, int(size).bit_length() + SPARE_BITS)
    return np.uint64((1 << 64) - (1 << (64 - bits)))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key; it never falls along sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of the sorted keys for each bucket that has any."""
    if len(sorted_keys):
        own = buckets_of(sorted_keys, buckets)
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for a, b in zip(at, [*at[1:], len(own)], strict=True):
            yield int(own[a]), slice(int(a), int(b))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one blob; integers byte plane by byte plane, which compresses well."""
    parts = [b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that :func:`pack` was given, of these dtypes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def pack_keys(sorted_keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as steps, with arrays of equal length."""
    return pack(np.diff(sorted_keys, prepend=np.uint64(0)), *more)


def unpack_keys(blob: bytes, *kinds: str) -> list[np.ndarray]:
    steps, *more = unpack(blob, "<u8", *kinds)
    return [np.cumsum(steps, dtype=np.uint64), *more]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, so that one block is unpacked at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def joined(blocks: DataFrame, asked: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with what is asked of them.  Both sides go by block at every size: what is asked grows with
    the corpus, so it is never broadcast."""
    return blocks.join(asked.hint("merge"), "block", how)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """The blocks with the blobs that each table of answers (block, bucket, blob) has for them.

    Columns answers0, answers1, ...: arrays of (bucket, blob), null where there are none.  A block's
    answers are bounded by the block.
    """
    out = blocks
    for i, table in enumerate(answers):
        own = table.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias(f"answers{i}"))
        out = joined(out, own, "left")
    return out


def windows(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The places where a window of so many words begins within one document."""
    lens = np.diff(starts)
    counts = np.maximum(lens - width + 1, 0)
    ends = np.cumsum(counts)
    return np.repeat(starts[:-1] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Fixed odd multipliers for the places of a window, from a seeded generator.
_PLACES = np.random.default_rng(97).integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the width words from each place; lanes are independent of each other."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), STEP):
        own, part = at[a : a + STEP], out[a : a + STEP]
        for j in range(width):
            part += words[own + j] * _PLACES[lane, j]
        part[:] = mixed(part)
    return out
