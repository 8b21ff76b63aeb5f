"""LM scoring with an Elias-Fano n-gram trie.

Counts of words, bigrams and trigrams of the training rows are summed over the whole corpus, and every
document is scored by a trigram model.  A block of documents asks the buckets of a hash space for the
corpus' counts of its own n-grams, and from the answers builds the part of the trie that its documents
need.  So neither a machine nor the driver ever holds the model of the whole corpus, and what is
shuffled grows with the input: one packed entry for each distinct n-gram of a block.

The counts can be kept as a model, a table of key ranges whose levels are Elias-Fano lists, and score other
texts: their blocks ask it in the same way.

Smoothing is Dirichlet: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first
word.  m is set for each order so that the mass for unseen words equals the share of n-grams seen once.
Words discount n1 / (n1 + 2 n2) of a count; all known words and one unknown word share what that leaves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.elias_fano import Buffer, EliasFano, NgramTrie
from tidemark.llm.shared import session_of, stored

#: The end of a text as a word: white space can't be part of any.
END = hashlib.blake2b(b"\n", digest_size=16).digest()
BINS = 64
HELD_OUT_OF, HELD_OUT_IS = 5, 1
#: Bytes of text in a block; a token takes some hundred bytes while a block is scored.
BLOCK_BYTES = 5 << 20

ANSWER = "block long, bucket long, one binary, two binary, three binary"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT_IS


@dataclass
class Tokens:
    """A block as tokens: words with an end after each text.

    words: local numbers, in the order of the words' hashes; hashes: of the distinct words, by number;
    keys: of the bigram and trigram that end at each token, where depth allows them.
    """

    words: np.ndarray
    starts: np.ndarray
    depth: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    keys: list[np.ndarray]

    @property
    def unknown(self) -> np.ndarray:
        """Whether each token is of a held-out document."""
        return np.repeat(self.held, np.diff(self.starts))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the number of each place's value)."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def tokens_of(block: B.Block, mask: np.uint64) -> Tokens:
    n = np.diff(block.starts)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    lanes = np.empty((2, int(starts[-1])), np.uint64)
    inner = np.ones(lanes.shape[1], bool)
    inner[starts[1:] - 1] = False
    lanes[:, inner] = block.hashes
    lanes[:, starts[1:] - 1] = np.frombuffer(END, "<u8").reshape(2, 1)
    used, first, words = grouped(lanes[0])
    depth = np.arange(lanes.shape[1]) - np.repeat(starts[:-1], n + 1)
    keys = []
    for order in (2, 3):
        # Before the first words of a block there is nothing; depth keeps these places unused.
        key = np.zeros(lanes.shape[1], np.uint64)
        if len(key) >= order:
            key[order - 1 :] = B.window_hashes(lanes[0], np.arange(len(key) - order + 1), order, lane=1) & mask
        keys.append(key)
    held = np.array([held_out(i) for i in block.ids], bool)
    return Tokens(words, starts, np.minimum(depth, 2), held, np.stack([used, lanes[1][first]]), keys)


def _distinct(keys: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (lowest bit clear) and how often each stands in training rows."""
    both = np.sort(keys | unknown)
    names = both & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, np.int64)
    known = np.concatenate([[0], np.cumsum(1 - (both & np.uint64(1)).astype(np.int64))])
    ends = np.append(first[1:], len(names))
    return names[first], known[ends] - known[first]


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of each entry's key, sums of distinct keys)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(tuple(reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
    return out, sums


def _statistics(sums: np.ndarray) -> np.ndarray:
    """How many keys occur once and twice, and by power of two how many keys there are and their sum."""
    sums = sums[sums > 0]
    bins = np.frexp(sums.astype(float))[1] - 1
    return np.concatenate([[(sums == 1).sum(), (sums == 2).sum()], np.bincount(bins, minlength=BINS),
                           np.bincount(bins, weights=sums, minlength=BINS)]).astype(np.int64)


@dataclass(frozen=True)
class Smoothing:
    """What the model knows of the corpus as a whole."""

    total: int
    types: int
    discount: float
    masses: tuple[float, float]

    @staticmethod
    def of(stats: np.ndarray) -> Smoothing:
        """stats: a row of :func:`_statistics` for each order."""
        once, twice = int(stats[0, 0]), int(stats[0, 1])
        discount = once / (once + 2 * twice) if once else 0.5
        masses = []
        for order in (1, 2):
            kinds, sums = stats[order - 1, 2 : 2 + BINS], stats[order - 1, 2 + BINS :]
            own = kinds > 0
            kinds, sums = kinds[own].astype(float), sums[own].astype(float)
            size, single = sums / np.maximum(kinds, 1), float(stats[order, 0])
            low, high = 1e-3, 1e9
            for _ in range(100):
                middle = (low * high) ** 0.5
                if (sums * middle / (size + middle)).sum() < single:
                    low = middle
                else:
                    high = middle
            masses.append(low)
        return Smoothing(int(stats[0, 2 + BINS :].sum()), int(stats[0, 2 : 2 + BINS].sum()), discount, tuple(masses))

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts.

        What the discounts leave is shared evenly by all known words and one unknown word, so that no unknown word is
        likelier than one that was seen.
        """
        if not self.total:
            return np.ones(len(counts))
        shared = self.discount * self.types / self.total / (self.types + 1)
        return np.maximum(counts - self.discount, 0) / self.total + shared

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))


def _scored(t: Tokens, one: np.ndarray, counts: list[np.ndarray], s: Smoothing) -> np.ndarray:
    """The probability of each token.

    one: the corpus' counts of the block's words; counts: those of its distinct bigram and trigram keys,
    in key order.  What the corpus has of these goes into a trie, and every distinct n-gram of the block
    is asked for in order, so that each search goes through the trie once.
    """
    words = len(one)
    m, k = s.masses
    two_at, three_at = np.flatnonzero(t.depth >= 1), np.flatnonzero(t.depth >= 2)
    by_token = []
    for at, keys, known in ((two_at, t.keys[0], counts[0]), (three_at, t.keys[1], counts[1])):
        _, _, number = grouped(keys[at])
        each = np.zeros(len(t.words), np.int64)
        each[at] = known[number]
        by_token.append(each)
    two, three = by_token
    # Distinct bigrams in the order of (context, word); distinct trigrams in that of (bigram, word).
    codes, first, number = grouped(t.words[two_at - 1] * words + t.words[two_at])
    pair_of = np.full(len(t.words), -1, np.int64)
    pair_of[two_at] = number
    c_two = two[two_at[first]]
    triple, first, triple_of = grouped(pair_of[three_at - 1] * words + t.words[three_at])
    at = three_at[first]
    head, tail, c_three = triple // words, pair_of[at], three[at]

    known = c_two > 0
    rank = np.cumsum(known) - 1
    pairs = np.stack([codes[known] // words, codes[known] % words], axis=1)
    full = (c_three > 0) & known[head] & known[tail]
    trie = NgramTrie.build(
        s.word(one), m / (one + m), pairs, c_two[known] / (one[pairs[:, 0]] + m), k / (c_two[known] + k),
        rank[head[full]], rank[tail[full]], c_three[full] / (c_two[head[full]] + k),
    )
    node = trie.bigrams(codes // words, codes % words)
    p_two = trie.add_bigram(node, codes // words, trie.word(codes % words))
    p_three = trie.add_trigram(node[head], node[tail], codes[tail] // words, p_two[tail])
    out = trie.word(t.words)
    out[two_at] = p_two[number]
    out[three_at] = p_three[triple_of]
    return out


NAMES = ["block", "bucket", "one", "two", "three"]
SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(values: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], names=NAMES)


def _asked(table: DataFrame, buckets: int, mask: np.uint64) -> DataFrame:
    """(block, bucket, one, two, three): each block's distinct n-grams, with their counts in its training rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True)
                t = tokens_of(block, mask)
                unknown = t.unknown
                one, short = t.hashes[0], (t.hashes[1] >> np.uint64(32)).astype(np.uint32)
                count = np.bincount(t.words[~unknown], minlength=len(one))
                parts: dict[int, list] = {b: [B.pack_keys(one[s], short[s], count[s].astype("<u4")), None, None]
                                          for b, s in B.cuts(one, buckets)}
                for i, (keys, least) in enumerate(zip(t.keys, (1, 2), strict=True)):
                    own = t.depth >= least
                    names_, count = _distinct(keys[own], unknown[own])
                    for b, s in B.cuts(names_, buckets):
                        blob = B.pack_keys(names_[s], count[s].astype("<u4"))
                        parts.setdefault(b, [None, None, None])[i + 1] = blob
                yield _rows([(block.number, b, *blobs) for b, blobs in parts.items()])

    return table.mapInArrow(send, ANSWER)


def _questions(bucket: pa.Table, level: int) -> list[tuple[int, list[np.ndarray]]]:
    """(row, keys, what else the keys have, counts) of the rows of a bucket that ask at this level."""
    kinds = ["<u4", "<u4"] if level == 0 else ["<u4"]
    return [(j, B.unpack_keys(x, *kinds)) for j, x in enumerate(bucket.column(NAMES[2 + level]).to_pylist()) if x is not None]


def _smoothing(stats: DataFrame) -> Smoothing:
    """From a row (one) of statistics for each bucket: their sums, which are of a fixed size, come to the driver."""
    width = 2 + 2 * BINS

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 * width, np.int64)
        for batch in batches:
            for x in batch.column("one").to_pylist():
                sums += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(3 * width)), pa.array(sums)], names=["place", "n"])

    found = np.zeros(3 * width, np.int64)
    for r in stats.mapInArrow(added, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        found[r.place] = r.n
    return Smoothing.of(found.reshape(3, width))


def _scores(table: DataFrame, answers: DataFrame, mask: np.uint64, smoothing: Smoothing, id_col: str) -> DataFrame:
    """The scores of a table of blocks, from the corpus' counts of what each of them asked."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in B.rows_of(batch):
                block = B.read_block(row, lower=True)
                t = tokens_of(block, mask)
                own = sorted(row["answers"], key=lambda a: a["bucket"])
                counts = [[B.unpack(a[name], "<u8")[0] for a in own if a[name] is not None] for name in NAMES[2:]]
                counts = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in counts]
                one = counts[0]
                logs = np.log10(_scored(t, one, counts[1:], smoothing))
                n = np.diff(t.starts)
                sums = lambda x: np.add.reduceat(x, t.starts[:-1])
                known = one[t.words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array(t.held), pa.array(n), pa.array(sums((known > 0).astype(np.int64))),
                     pa.array(np.full(len(n), smoothing.total)), pa.array(sums(smoothing.base(known))), pa.array(sums(logs))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    given = answers.groupBy("block").agg(F.collect_list(F.struct(*NAMES[1:])).alias("answers"))
    return B.joined(table, given).mapInArrow(score, SCORED).withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are what stands between ASCII white space, lower-cased (A-Z); the end of a text is a token.
    Rows with crc32(id) mod 5 = 1 are held out, all others train; a null id trains.  base_score is the
    add-a-half unigram score, score the trigram model's, both as log10.  Null and empty texts are the
    end token alone; repeated rows each count and get their row; without training rows both scores
    are 0.  Ids are integers, or texts that Spark casts to long; other texts are an error.  Other columns are
    not read; an empty table gives an empty result.

    The scores are those of :func:`train_model` and :func:`score_with` one after the other.  As the corpus scores
    itself here, its n-grams are sent once for both: what trains the model is also what asks it.
    """
    table = B.pack_blocks(docs, id_col, text_col, block_bytes)
    buckets, mask = B.bucket_count(table), B.key_mask(table)

    def total(bucket: pa.Table) -> pa.Table:
        """Each block's counts in the order it asked, and a row of statistics."""
        numbers, own = bucket.column("block").to_pylist(), bucket.column("bucket").to_pylist()
        answers: list[list] = [[n, b, None, None, None] for n, b in zip(numbers, own, strict=True)]
        stats = np.zeros((3, 2 + 2 * BINS), np.int64)
        for i in range(3):
            asked = _questions(bucket, i)
            if asked:
                columns = [np.concatenate([a[c] for _, a in asked]) for c in range(len(asked[0][1]))]
                each, sums = _summed(columns[:-1], columns[-1].astype(np.int64))
                stats[i] = _statistics(sums)
                at = 0
                for j, a in asked:
                    answers[j][2 + i] = B.pack(each[at : at + len(a[0])].astype("<u8"))
                    at += len(a[0])
        answers.append([-1, own[0], stats.tobytes(), None, None])
        return pa.Table.from_batches([_rows([tuple(a) for a in answers])])

    answers = stored(_asked(table, buckets, mask).groupBy("bucket").applyInArrow(total, ANSWER), "counts", codec="uncompressed")
    smoothing = _smoothing(answers.where("block = -1"))
    return _scores(table, answers.where("block >= 0"), mask, smoothing, id_col)


@dataclass(frozen=True)
class LanguageModel:
    """A trained model: a table with a row for each range of keys, and what is known of the corpus as a whole.

    A row has three levels, words, bigrams and trigrams: the keys as an Elias-Fano list, and their counts.  The table
    is as large as the corpus has n-grams and stays on the executors; all else is of a fixed size.
    """

    levels: DataFrame
    buckets: int
    mask: int
    smoothing: Smoothing

    def save(self, path: str) -> None:
        """Write the model to a folder of any Hadoop file system."""
        s = self.smoothing
        self.levels.write.parquet(f"{path}/levels")
        row = [(self.buckets, str(self.mask), s.total, s.types, s.discount, *s.masses)]
        session_of(self.levels).createDataFrame(row, META).coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LanguageModel:
        r = spark.read.parquet(f"{path}/meta").first()
        smoothing = Smoothing(r.total, r.types, r.discount, (r.mass_one, r.mass_two))
        return LanguageModel(spark.read.parquet(f"{path}/levels"), r.buckets, int(r.mask), smoothing)


META = "buckets long, mask string, total long, types long, discount double, mass_one double, mass_two double"


def _low_bit(mask: int) -> int:
    """How many low bits no key has."""
    return (mask & -mask).bit_length() - 1


def _packed_level(keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, shift: int) -> bytes:
    """A level of a range of keys: its least key, the steps from there as an Elias-Fano list, and the counts."""
    out = Buffer()
    base = keys[:1]
    steps = (keys - base[0]) >> np.uint64(shift) if len(keys) else keys
    out.put(base)
    EliasFano.put(steps.astype(np.int64), out)
    out.put(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))
    out.put(more if more is not None else np.empty(0, "<u4"))
    return b"".join(out.parts)


def _found_counts(level: bytes | None, keys: np.ndarray, more: np.ndarray | None, shift: int) -> np.ndarray:
    """The counts that a level has of these keys, 0 where it has none."""
    out = np.zeros(len(keys), np.int64)
    if level is None or not len(keys):
        return out
    source = Buffer(memoryview(level))
    base, steps = source.take(), EliasFano.take(source)
    counts, others = source.take(), source.take()
    if not len(base):
        return out
    inside = np.flatnonzero(keys >= base[0])
    place = steps.search(((keys[inside] - base[0]) >> np.uint64(shift)).astype(np.int64))
    inside, place = inside[place >= 0], place[place >= 0]
    if more is None:
        out[inside] = counts[place]
        return out
    # Words are known by more bits than their place in the list; words of equal keys follow each other.
    while len(inside):
        same = others[place] == more[inside]
        out[inside[same]] = counts[place[same]]
        inside, place = inside[~same], place[~same] + 1
        on = place < len(counts)
        inside, place = inside[on], place[on]
        on = steps.access(place) == ((keys[inside] - base[0]) >> np.uint64(shift)).astype(np.int64)
        inside, place = inside[on], place[on]
    return out


#: Bits by which the keys of words are shortened in a level; the rest of a word's bits is held beside it.
WORD_SHIFT = 24


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> LanguageModel:
    """The trigram model of the rows that train (see :func:`score_documents`), as a stored table."""
    table = B.pack_blocks(docs, id_col, text_col, block_bytes)
    buckets, mask = B.bucket_count(table), B.key_mask(table)
    shifts = (WORD_SHIFT, *[_low_bit(int(mask))] * 2)

    def summed(bucket: pa.Table) -> pa.Table:
        stats, levels = np.zeros((3, 2 + 2 * BINS), np.int64), []
        for i, shift in enumerate(shifts):
            asked = _questions(bucket, i)
            columns = [np.concatenate([a[c] for _, a in asked]) for c in range(3 if i == 0 else 2)] if asked else []
            if not asked:
                levels.append(None)
                continue
            *keys, counts = columns
            order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort((keys[1], keys[0]))
            new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
            first = np.flatnonzero(np.concatenate([[True], new]))
            sums = np.add.reduceat(counts[order].astype(np.int64), first)
            stats[i] = _statistics(sums)
            first, sums = order[first][sums > 0], sums[sums > 0]
            more = None
            if i == 0:
                # The bits that the shortened key lacks go first, so that words are told apart as well as before.
                more = keys[1][first].astype("<u8") | (keys[0][first] & np.uint64((1 << WORD_SHIFT) - 1)) << np.uint64(32)
            levels.append(_packed_level(keys[0][first] >> np.uint64(shift) << np.uint64(shift), more, sums, shift))
        number = bucket.column("bucket")[0].as_py()
        return pa.Table.from_batches([_rows([(0, number, *levels), (-1, number, stats.tobytes(), None, None)])])

    out = stored(_asked(table, buckets, mask).groupBy("bucket").applyInArrow(summed, ANSWER), "model", codec="uncompressed")
    return LanguageModel(out.where("block = 0").drop("block"), buckets, int(mask), _smoothing(out.where("block = -1")))


def score_with(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score documents, of whatever corpus, with a trained model; columns and cases as in :func:`score_documents`."""
    table = B.pack_blocks(docs, id_col, text_col, block_bytes)
    mask, shifts = np.uint64(model.mask), (WORD_SHIFT, *[_low_bit(model.mask)] * 2)

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        answers: list[list] = [[n, b, None, None, None] for n, b in zip(asked.column("block").to_pylist(), asked.column("bucket").to_pylist(), strict=True)]
        for i, shift in enumerate(shifts):
            level = known.column(NAMES[2 + i])[0].as_py() if known.num_rows else None
            for j, (keys, *rest) in _questions(asked, i):
                more = None
                if i == 0:
                    more = rest[0].astype("<u8") | (keys & np.uint64((1 << WORD_SHIFT) - 1)) << np.uint64(32)
                short = keys >> np.uint64(shift) << np.uint64(shift)
                answers[j][2 + i] = B.pack(_found_counts(level, short, more, shift).astype("<u8"))
        return pa.Table.from_batches([_rows([tuple(a) for a in answers])])

    asked = _asked(table, model.buckets, mask).groupBy("bucket")
    answers = asked.cogroup(model.levels.groupBy("bucket")).applyInArrow(look_up, ANSWER)
    return _scores(table, stored(answers, "counts", codec="uncompressed"), mask, model.smoothing, id_col)
