"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, one of k + 1 pieces of a test item is free of errors wherever the
item occurs.  An automaton over all pieces finds exact piece hits, and the text around each hit is
verified with Myers' bit-parallel edit distance.  Short items are found exactly, as whole words.

The benchmark's size is read first.  It is broadcast in blocks of a bounded number of characters, and
each block is held against all documents, a map without shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import session_of, text_of

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 20
#: Items of fewer normalised characters are short: found without edits, as whole words, and marked in the result.
MIN_CHARS = 24
#: Characters of items in one broadcast.
BLOCK_CHARS = 1_000_000

WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-case words of letters and digits, joined by one space."""
    return " ".join(WORD.findall(text.lower()))


def distances(pattern: str, text: str) -> Iterator[int]:
    """After each character of text, the least edit distance of pattern to what ends there (Myers)."""
    m = len(pattern)
    mask = (1 << m) - 1
    high = 1 << (m - 1)
    equal: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        equal[char] |= 1 << i
    plus, minus, score = mask, 0, m
    for char in text:
        eq = equal.get(char, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(diagonal | plus) & mask)
        down = plus & diagonal
        score += bool(up & high) - bool(down & high)
        up = (up << 1) & mask
        plus = ((down << 1) & mask) | (~(diagonal | up) & mask)
        minus = up & diagonal
        yield score


def _ends(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence, the first of several; None beyond the budget."""
    best, at = budget + 1, 0
    for i, d in enumerate(distances(pattern, text)):
        if d < best:
            best, at = d, i + 1
    return (best, at) if best <= budget else None


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            norm = plain(text or "")
            if not norm:
                continue
            budget = len(norm) // CHARS_PER_EDIT if len(norm) >= MIN_CHARS else 0
            cuts = [len(norm) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[norm[a:b]].append((len(self.items), a))
            self.items.append((item_id, norm, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(item id, start, end, distance, whether the item is short) of each occurrence in the normalised text, by item and place."""
        if not self.items:
            return []
        norm = plain(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(norm):
            for k, offset in places:
                if size == len(self.items[k][1]) < MIN_CHARS and (
                        norm[end - size : end + 1 - size].strip() or norm[end + 1 : end + 2].strip()):
                    continue
                if (start := end + 1 - size - offset) >= -self.items[k][2]:
                    starts[k].add(start)
        out = []
        for k in sorted(starts):
            item_id, pattern, budget = self.items[k]
            places, at, done = sorted(starts[k]), 0, 0
            while at < len(places):
                # Hits of one occurrence start within the budget of each other.
                first = places[at]
                while at < len(places) and places[at] <= first + budget:
                    at += 1
                low, high = max(done, first - budget), places[at - 1] + len(pattern) + budget
                found = _ends(pattern, norm[low:high], budget)
                if found is None:
                    continue
                end = low + found[1]
                back = _ends(pattern[::-1], norm[max(done, end - len(pattern) - budget) : end][::-1], budget)
                out.append((item_id, end - back[1], end, found[0], len(pattern) < MIN_CHARS))
                done = end
                # The next occurrence begins where this one has ended, or later.
                at = max(at, bisect_left(places, done - budget))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r.id, r.text) for r in items.where(part == b).toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per occurrence of an item in a document: id, item id, start, end, distance, short.

    Occurrences of one item don't overlap: they are found from left to right, each after the end of the one before.
    Ids and item ids keep their types, whatever these are.
    Texts are compared as lower-case words joined by one space; start and end are places in that form,
    end exclusive.  An item may differ by one edit for each CHARS_PER_EDIT characters.  Null and empty
    texts contain nothing; items under MIN_CHARS must occur without edits and as whole words, and short
    is true in their rows; items without letters and digits occur nowhere.  Repeated rows and items each
    give their rows; empty tables give an empty result.
    """
    spark = session_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kinds = (rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    schema = f"id {kinds[0]}, item {kinds[1]}, start int, end int, distance int, short boolean"
    kind = benchmark.select(item_col).limit(0).toArrow().schema.types[0]
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    hits = matcher.find(text)
                    at += [i] * len(hits)
                    found += hits
                ids = batch.column("id").take(pa.array(at, pa.int64()))
                columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((kind, pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "item", "start", "end", "distance", "short"])

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    spark = session_of(docs)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not matcher.find(x or "") for x in texts], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
