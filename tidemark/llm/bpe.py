"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words that are frequent in the corpus are merged once, on the driver, and compiled into a minimal
acyclic automaton whose arcs carry outputs: their sum along a word is its place in the table of token
ids.  Equal suffixes share states.  The automaton is broadcast as one buffer (its size is bounded by
``lexicon_size``), and every Python worker memory-maps it.  Words it does not have are merged exactly,
so the lexicon changes the speed and never the ids.

Encoding itself is a map over documents; the only shuffle sums word counts for the lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import session_of, text_of

# The white space of Unicode, and the letters and digits that Unicode 16 adds to 15.1.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEWER_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B "
    "1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C "
    "18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def _class(general: str, newer: str) -> str:
    """A general category as the inside of a character class."""
    codes = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == general}
    for pair in newer.split():
        first, last = (int(x, 16) for x in pair.split("-"))
        codes.update(c for c in range(first, last + 1) if unicodedata.category(chr(c)) == "Cn")
    out, spans = "", iter(sorted(codes))
    first = last = next(spans)
    for code in [*spans, -1]:
        if code != last + 1:
            out += f"{chr(first)}-{chr(last)}"
            first = code
        last = code
    return out


LETTER, NUMBER = _class("L", NEWER_LETTERS), _class("N", NEWER_NUMBERS)
#: A word with the space before it, or a run of white space; the finer pattern works inside of these.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{WHITE}{LETTER}{NUMBER}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)

#: The kinds of code points that the pattern knows; an apostrophe may begin a contraction.
OTHER, LETTERS, NUMBERS, WHITES = range(4)
SPACE, APOSTROPHE = ord(" "), ord("'")


def _kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, ranges in ((LETTERS, LETTER), (NUMBERS, NUMBER)):
        for first, last in zip(ranges[::3], ranges[2::3], strict=True):
            out[ord(first) : ord(last) + 1] = kind
    out[[ord(c) for c in re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))]] = WHITES
    return out


KINDS = _kinds()

LEXICON_SIZE = 65_536
MIN_COUNT = 3
#: Longer words are left to the exact merge, which bounds the lexicon that is broadcast.
LEXICON_WORD_BYTES = 256
#: Text bytes that a task holds as chunks at a time, and chunks that a task remembers.
PART_BYTES = 2 << 20
REMEMBERED = 200_000
#: Longer words are merged with a heap, one by one.
SHORT = 48
#: Words of up to so many bytes are merged together, to bound the padding.
BANDS = (6, 10, 16, 28, SHORT)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: ids of single bytes, merges by pair of ids, bytes of each id."""

    single: list[int]
    merges: dict[int, tuple[int, int]]
    bytes_of: list[bytes]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a vocabulary file of the tokenizers library (byte-level BPE)."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            table[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            table[i] = token.encode()
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        return Vocabulary([ids[c] for c in letters], merges, table, special)


class Merger:
    """The exact merges: always the pair of the lowest rank, of equal ones the leftmost.

    ``merge_all`` merges many words at once: a row of a matrix for each, a pair of each row a round.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.single = np.array(vocabulary.single, np.int64)
        self.merges = vocabulary.merges
        keys = np.fromiter(vocabulary.merges, np.int64, len(vocabulary.merges))
        ranks = np.fromiter((r for r, _ in vocabulary.merges.values()), np.int64, len(keys))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order].astype(np.int32)
        self.made = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        self.made[ranks] = np.fromiter((n for _, n in vocabulary.merges.values()), np.int64, len(keys))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, self.NONE, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.NONE)

    def _band(self, flat: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
        """Token ids of words of up to width bytes, a row each, -1 behind the end."""
        ids = np.full((len(lens), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < lens[:, None]] = self.single[flat]
        out = ids
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(len(lens)), np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            more = best < self.NONE
            if not more.all():
                out[rows[~more]] = ids[~more]
                rows, ids, rank, at, best = rows[more], ids[more], rank[more], at[more], best[more]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = self.made[best]
            ids[:, 1:-1] = np.take_along_axis(ids, columns[1:] + (columns[1:] > at[:, None]), 1)
            ids[:, -1] = -1
            rank[:, :-1] = np.take_along_axis(rank, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            rank[:, -1] = self.NONE
            rank[each, at] = self._rank(ids[each, at], ids[each, at + 1])
            before = np.maximum(at - 1, 0)
            left = self._rank(ids[each, before], ids[each, before + 1])
            rank[each, before] = np.where(at > 0, left, rank[each, before])
        return out

    def merge_all(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lens): the tokens of word i are ids[starts[i] : starts[i] + lens[i]]."""
        flat, begins, sizes = flat_of(words)
        starts, lens = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, total, least = [], 0, 0
        for width in BANDS:
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(own):
                found = self._band(_gathered(flat, begins, sizes, own), sizes[own], width)
                there = found >= 0
                lens[own] = there.sum(axis=1)
                starts[own] = total + np.cumsum(lens[own]) - lens[own]
                parts.append(found[there].astype(np.uint32))
                total += len(parts[-1])
        for i in np.flatnonzero(sizes > SHORT):
            parts.append(np.array(_merge_long(self.single[flat[begins[i] : begins[i] + sizes[i]]].tolist(), self.merges), np.uint32))
            starts[i], lens[i] = total, len(parts[-1])
            total += len(parts[-1])
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), starts, lens


def _merge_long(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    after = [*range(1, len(ids)), -1]
    before = [*range(-1, len(ids) - 1)]
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            found = merges.get(ids[i] << 32 | ids[after[i]])
            if found is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        after[j] = -1
        offer(i)
        offer(before[i])
    return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over bytes whose arc outputs sum to a word's number.

    ``compile`` builds it from sorted words, sharing equal suffixes; ``open`` maps the buffer.
    ``lookup`` walks all asked words at once, one byte a step.
    """

    HEADER = 6

    def __init__(self, buffer: memoryview | bytes) -> None:
        head = np.frombuffer(buffer, "<i8", self.HEADER)
        arcs, words, total, self.longest, finals, self.root = (int(x) for x in head)
        at = self.HEADER * 8
        self.keys = np.frombuffer(buffer, "<i8", arcs, at)
        at += arcs * 8
        self.target = np.frombuffer(buffer, "<i4", arcs, at)
        at += arcs * 4
        self.output = np.frombuffer(buffer, "<i4", arcs, at)
        at += arcs * 4
        self.final = np.frombuffer(buffer, "u1", finals, at)
        at += finals
        at += -at % 8
        self.offsets = np.frombuffer(buffer, "<i8", words + 1, at)
        at += (words + 1) * 8
        self.ids = np.frombuffer(buffer, "<u4", total, at)

    @staticmethod
    def compile(words: list[bytes], ids: list[list[int]]) -> bytes:
        """The buffer for the sorted distinct words and their token ids."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        below: list[int] = []

        def settle(node: list) -> int:
            final, arcs = node
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                below.append(final + sum(below[t] for _, t in arcs))
            return register[key]

        # path[i]: the open state after i bytes of the last word, as [is final, arcs].
        path, last = [[False, []]], b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1][1].append((last[i - 1], settle(path.pop())))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], settle(path.pop())))
        root = settle(path[0])
        keys, target, output = [], [], []
        for state, (final, arcs) in enumerate(states):
            passed = int(final)
            for label, to in arcs:
                keys.append(state << 8 | label)
                target.append(to)
                output.append(passed)
                passed += below[to]
        lens = [len(x) for x in ids]
        flat = np.array([y for x in ids for y in x], "<u4")
        longest = max(map(len, words), default=0)
        head = np.array([len(keys), len(words), len(flat), longest, len(states), root], "<i8")
        parts = [head.tobytes(), np.array(keys, "<i8").tobytes(), np.array(target, "<i4").tobytes(),
                 np.array(output, "<i4").tobytes(), np.array([f for f, _ in states], "u1").tobytes()]
        parts.append(b"\0" * (-sum(map(len, parts)) % 8))
        parts += [np.concatenate([[0], np.cumsum(lens)]).astype("<i8").tobytes(), flat.tobytes()]
        return b"".join(parts)

    @staticmethod
    def open(buffer: bytes) -> Transducer:
        """The automaton on a memory-mapped file that has no name any more, so nothing stays behind."""
        with tempfile.TemporaryFile() as file:
            file.write(buffer)
            file.flush()
            return Transducer(memoryview(mmap.mmap(file.fileno(), len(buffer), access=mmap.ACCESS_READ)))

    def lookup(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The number of each word, -1 for those that the lexicon does not have."""
        flat, starts, lens = flat_of(words)
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((lens <= self.longest) & (lens > 0))
        if not len(live) or not len(self.keys):
            return out
        lens, starts = lens[live], starts[live]
        state = np.full(len(live), self.root, np.int64)
        number = np.zeros(len(live), np.int64)
        for step in range(int(lens.max())):
            key = state << 8 | flat[starts + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[arc] == key
            live, lens, starts, arc = live[has], lens[has], starts[has], arc[has]
            state, number = self.target[arc].astype(np.int64), number[has] + self.output[arc]
            ended = lens == step + 1
            if ended.any():
                good = ended & (self.final[state] == 1)
                out[live[good]] = number[good]
                go = ~ended
                live, lens, starts, state, number = live[go], lens[go], starts[go], state[go], number[go]
            if not len(live):
                break
        return out


#: In RE2's spelling: a space in the middle of a white-space run, or at its end before the end of the text.
_WHITE_RE2 = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", WHITE)
INNER_SPACE = rf"[{_WHITE_RE2}] (?:[{_WHITE_RE2}]|\z)"


def cut_at_spaces(texts: pa.Array, special: Iterable[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(which, parts, offsets): the texts that may be cut at spaces, and their parts.

    Where no space stands inside of a white-space run, cutting at spaces is as good as the pattern:
    what follows a space begins a piece, and a run before a space is a piece of its own.  All parts
    but the first of a text have a space before them.
    """
    slow = pc.match_substring_regex(texts, INNER_SPACE)
    for name in special:
        slow = pc.or_(slow, pc.match_substring(texts, name))
    which = np.flatnonzero(~slow.to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(texts.take(pa.array(which)), " ")
    return which, lists.flatten(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)


def chunks_of(keys: pa.Array) -> pa.Array:
    """Keys are ``' ' + chunk``, or a chunk without the one space that it begins with."""
    return pc.if_else(pc.starts_with(keys, " "), pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise("", keys, " "))


def pieces_of(chunks: pa.Array, special: Iterable[str]) -> tuple[pa.Array, np.ndarray]:
    """(pieces, many): the pieces of all chunks in turn, as bytes, and how many each has.

    A piece is a run of one kind.  The space that a chunk begins with goes with the run behind it, and of
    white space that something follows the last one is a piece of its own.  Chunks that may have
    contractions go through the pattern; special tokens are one piece.
    """
    data, starts, lens = flat_of(chunks.cast(pa.binary()))
    data = data[starts[0] : starts[-1] + lens[-1]] if len(chunks) else data[:0]
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    place = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.searchsorted(place, np.concatenate([[0], np.cumsum(lens)]))
    first = np.zeros(len(codes) + 1, bool)
    first[edges] = True
    kind = KINDS[codes]
    white = kind == WHITES
    begin = first[:-1].copy()
    inner = ~first[1:-1]
    changed = kind[1:] != kind[:-1]
    spaced = first[:-2] & (codes[:-1] == SPACE) & ~white[1:] if len(codes) > 1 else inner
    last = white[1:-1] & ~white[2:] & ~first[2:-1]
    begin[1:] |= inner & changed & ~spaced
    begin[1:-1] |= inner[:-1] & white[:-2] & last
    odd = codes == APOSTROPHE
    odd[1:-1] |= ~first[1:-2] & (codes[1:-1] == SPACE) & last
    whole = pc.is_in(chunks, value_set=pa.array(list(special), pa.string())).to_numpy(zero_copy_only=False)
    chunk = np.searchsorted(edges, np.flatnonzero(odd), side="right") - 1
    for i in np.unique(np.concatenate([chunk, np.flatnonzero(whole)])).tolist():
        a, b = edges[i], edges[i + 1]
        begin[a:b] = False
        at = [a] if whole[i] else a + np.cumsum([0, *map(len, PIECE.findall(chunks[i].as_py()))])[:-1]
        begin[at] = True
    begins = np.flatnonzero(begin)
    offsets = np.append(place[begins], len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.diff(np.searchsorted(begins, edges))


def _splitter(special: Iterable[str]) -> re.Pattern | None:
    names = sorted(special, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def flat_of(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, lens): the bytes of words, and where each one begins there."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets or bytes(4), np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends)


def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows' slices of flat, one after the other."""
    size = lens[rows]
    ends = np.cumsum(size)
    shift = np.repeat(starts[rows] - ends + size, size)
    return flat[shift + np.arange(len(shift))]


class Encoder:
    """Encodes the texts of one task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer) -> None:
        self.vocabulary, self.lexicon, self.merger = vocabulary, lexicon, Merger(vocabulary)
        self.splitter = _splitter(vocabulary.special)
        self._forget()

    def _forget(self) -> None:
        # The keys that are known, and their tokens as slices of ids.
        self.keys = pa.array([], pa.string())
        self.ids, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, keys: pa.Array) -> np.ndarray:
        """The numbers of distinct keys; those that are new get their tokens."""
        out = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(out < 0)
        out[new] = len(self.keys) + np.arange(len(new))
        if len(new):
            self._solve(keys.take(pa.array(new)))
        return out

    def _solve(self, keys: pa.Array) -> None:
        special = self.vocabulary.special
        pieces, many = pieces_of(chunks_of(keys), special)
        coded = pieces.dictionary_encode()
        words, flat = coded.dictionary, coded.indices.to_numpy()
        found = self.lexicon.lookup(words)
        unseen = np.flatnonzero(found < 0)
        ids, starts, lens = self.merger.merge_all(words.take(pa.array(unseen)))
        own = self.lexicon.offsets
        begin, size = np.array(own[found]), np.array(own[np.minimum(found + 1, len(own) - 1)] - own[found])
        ids = np.concatenate([self.lexicon.ids, ids])
        begin[unseen], size[unseen] = starts + len(self.lexicon.ids), lens
        names = pa.array([x.encode() for x in special], pa.binary())
        for i in np.flatnonzero(pc.is_in(words, value_set=names).to_numpy(zero_copy_only=False)).tolist():
            begin[i], size[i] = len(ids), 1
            ids = np.append(ids, np.uint32(special[words[i].as_py().decode()]))
        ends = np.cumsum(many)
        sums = np.concatenate([[0], np.cumsum(size[flat])])
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts = np.concatenate([self.starts, len(self.ids) + sums[ends - many]])
        self.lens = np.concatenate([self.lens, sums[ends] - sums[ends - many]])
        self.ids = np.concatenate([self.ids, _gathered(ids, begin, size, flat)])

    def _slow_keys(self, text: str) -> list[str]:
        out = []
        for i, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            out += [" " + part] if i % 2 else [" " + chunk for chunk in CHUNK.findall(part)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lens): the token ids of all texts in turn, and how many each has."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        which, parts, offsets = cut_at_spaces(texts, self.vocabulary.special)
        coded = parts.dictionary_encode()
        heads = pc.binary_join_element_wise("", parts.take(pa.array(offsets[:-1])), " ")
        slow = np.setdiff1d(np.arange(len(texts)), which)
        found = [self._slow_keys(texts[i].as_py()) for i in slow.tolist()]
        more = pa.array([key for keys in found for key in keys], pa.string())
        distinct = pa.concat_arrays([coded.dictionary, heads, more]).dictionary_encode()
        number = self._numbers(distinct.dictionary)[distinct.indices.to_numpy()]
        at = np.cumsum([len(coded.dictionary), len(heads)])
        fast = number[coded.indices.to_numpy()]
        fast[offsets[:-1]] = number[at[0] : at[1]]
        # The keys of fast texts come first; rows puts all into the order of the texts.
        begin, many = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        begin[which], many[which] = offsets[:-1], np.diff(offsets)
        many[slow] = [len(keys) for keys in found]
        begin[slow] = len(fast) + np.cumsum(many[slow]) - many[slow]
        keys = np.concatenate([fast, number[at[1] :]])
        if len(slow):
            keys = _gathered(keys, begin, many, np.arange(len(texts)))
        sums = np.concatenate([[0], np.cumsum(self.lens[keys])])
        ends = np.cumsum(many)
        return _gathered(self.ids, self.starts, self.lens, keys), sums[ends] - sums[ends - many]


def decode(ids: np.ndarray, table: np.ndarray) -> bytes:
    """The bytes of token ids; table has the bytes of each id."""
    return b"".join(table[ids].tolist())


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, a longer text alone."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at)
            at = end


def frequent_words(docs: DataFrame, text_col: str = "text", special: Iterable[str] = (),
                   lexicon_size: int = LEXICON_SIZE, min_count: int = MIN_COUNT) -> list[bytes]:
    """The corpus' most frequent words, sorted by their bytes: at most lexicon_size of them.

    Counts cover all texts: each part of some MB that a task reads brings all of its words, and min_count
    holds for their sums.  Words of more than LEXICON_WORD_BYTES are not among them.
    """
    names = list(special)
    rows = lambda words, n: pa.RecordBatch.from_arrays(
        [pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(names)
        for batch in _parts(batches, 4 * PART_BYTES):
            texts = batch.column("text")
            which, parts, _ = cut_at_spaces(texts, names)
            found = pc.value_counts(parts)
            pieces, many = pieces_of(chunks_of(found.field("values")), ())
            coded = pieces.dictionary_encode()
            times = np.repeat(found.field("counts").to_numpy(), many)
            sums = np.bincount(coded.indices.to_numpy(), times, len(coded.dictionary)).astype(np.int64)
            kept = np.flatnonzero(flat_of(coded.dictionary)[2] <= LEXICON_WORD_BYTES)
            yield rows(coded.dictionary.take(pa.array(kept)), sums[kept])
            words = Counter()
            for i in np.setdiff1d(np.arange(len(texts)), which):
                for part in (splitter.split(texts[i].as_py()) if splitter else [texts[i].as_py()])[::2]:
                    words.update(PIECE.findall(part))
            more = [(key, n) for w, n in words.items() if len(key := w.encode()) <= LEXICON_WORD_BYTES]
            yield rows([w for w, _ in more], [n for _, n in more])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    top = top.orderBy(F.desc("n"), "word").limit(lexicon_size)
    return sorted(bytes(r.word) for r in top.toLocalIterator())


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
                  lexicon_size: int = LEXICON_SIZE, min_count: int = MIN_COUNT) -> bytes:
    words = frequent_words(docs, text_col, vocabulary.special, lexicon_size, min_count)
    ids, starts, lens = Merger(vocabulary).merge_all(words)
    return Transducer.compile(words, [ids[a : a + n].tolist() for a, n in zip(starts, lens, strict=True)])


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
               lexicon_size: int = LEXICON_SIZE, min_count: int = MIN_COUNT, with_decoded: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit integers), and on wish decoded.

    The ids are those of the vocabulary's own library without special tokens added; special tokens
    spelled out in a text are their ids.  Null and empty texts have no tokens; repeated rows each get
    their row; other columns are not read.  Texts are never cut.
    """
    spark = session_of(docs)
    vocabulary = Vocabulary.load(tokenizer_path)
    lexicon = build_lexicon(docs, vocabulary, text_col, lexicon_size, min_count)
    shared = spark.sparkContext.broadcast((vocabulary, lexicon))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, buffer = shared.value
        encoder = Encoder(vocabulary, Transducer.open(buffer))
        table = np.array(vocabulary.bytes_of, object)
        for batch in _parts(batches, PART_BYTES):
            ids, lens = encoder.encode(batch.column("text"))
            ends = np.cumsum(lens)
            packed = ids.astype("<u4").tobytes()
            columns = [batch.column("id"), pa.array(lens),
                       pa.array([packed[4 * (b - n) : 4 * b] for b, n in zip(ends, lens, strict=True)], pa.binary())]
            if with_decoded:
                texts = [decode(ids[b - n : b], table).decode("utf-8", "replace") for b, n in zip(ends, lens, strict=True)]
                columns.append(pa.array(texts, pa.string()))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"id {kind}, n_tokens long, ids binary" + ", decoded string" * with_decoded)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of encoded with the text of their packed ids; null ids give an empty text.

    A column that is named like the new one is replaced, as withColumn does.  Repeated rows each get their
    text; an empty table gives an empty result.
    """
    spark = session_of(encoded)
    others = [f for f in encoded.schema if f.name.lower() != out_col.lower()]
    shared = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path).bytes_of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(shared.value, object)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            packed = [np.frombuffer(x or b"", "<u4") for x in batch.column(at).to_pylist()]
            texts = [decode(x, table).decode("utf-8", "replace") for x in packed]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(texts, pa.string())],
                                             names=[*(f.name for f in others), out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return encoded.mapInArrow(scan, f"{kinds}, `{out_col}` string")
