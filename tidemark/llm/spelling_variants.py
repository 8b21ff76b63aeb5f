"""Spelling variants by merging the light subtrees of a trie, each with one character skipped or replaced.

The frequent words are the terminals of a trie whose nodes are their beginnings.  Of a node's branches the
one with the most words is heavy (heavy-path decomposition); a word leaves heavy paths at most log2 of the number of words
times, and only there it is merged, the smaller side into the larger:

* with the character replaced by the heavy one, or by that of another light branch, it meets words that differ in this character;
* with the character skipped, or the heavy one put before it, it meets words with one character less or more.

Where terminals coincide the words are one edit apart, and each such pair is met exactly once.  A merged terminal is
a row with its string, so coinciding ones are equal keys of a join with the words, or of a sum where both sides are
light; such a group has a word for each letter at one place, so at most as many as there are letters.

Nothing is held as a whole in one task: rows are words, nodes and merged terminals.  A node's row holds its string, so a word of n letters
makes n * n / 2 bytes of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: Letters that a run may have, in lower case.
LETTERS = 26 + 64
#: Forks of shorter beginnings than this go to every task: there are 1 + LETTERS + LETTERS ** 2 at most, each of some bytes.
SHORT = 3
MIN_LENGTH, MIN_COUNT = 5, 3
DAMAGE = 97


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of all texts, letters lost by a hash of row and word; null texts and ids count as empty."""
    lower = F.translate(text_of(text_col), UPPER, LOWER)
    runs = docs.select(text_of(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    draw = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    lost = "concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2))"
    words = draw.select((F.when(F.col("h") % damage == 0, F.expr(lost)).otherwise(F.col("run")) if damage else F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _better(n: Column, word: Column) -> Column:
    """A struct that is less for more frequent words, then for those that come first."""
    return F.struct((-n).alias("rank"), word.alias("word"))


def _light_edges(words: DataFrame) -> DataFrame:
    """(word, n, d, letter, heavy): where a word's letter after d others is not on the heavy path; '' where it ends at a fork."""
    # One row for each node on a word's path; the last one's letter is the end of the word.
    path = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("d")).select(
        "word", "n", "d", F.expr("left(word, d)").alias("node"), F.expr("substring(word, d + 1, 1)").alias("letter"))
    branches = path.groupBy("node", "letter").agg(F.count("*").alias("size"))
    heavy = F.max(F.when(F.col("letter") != "", F.struct("size", "letter")))["letter"]
    forks = branches.groupBy("node").agg(F.count("*").alias("branches"), heavy.alias("heavy"))
    forks = stored(forks.where(F.col("branches") > 1).select("node", "heavy"), "forks")
    near = path.where(F.col("d") < SHORT).join(F.broadcast(forks.where(F.length("node") < SHORT)), "node")
    far = path.where(F.col("d") >= SHORT).join(forks.where(F.length("node") >= SHORT), "node")
    return near.unionByName(far).where("letter <> heavy").drop("node")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the most frequent of them (rank, word); no row where none is."""
    light = stored(_light_edges(words), "light-edges")
    before, here, after = "left(word, d)", "substring(word, d + 1)", "substring(word, d + 2)"
    # Of a run of one letter the last is skipped, so each pair is met once.
    merged = light.select("word", "n", F.explode(F.array_compact(F.array(
        F.expr(f"if(letter <> '', concat({before}, heavy, {after}), null)"),
        F.expr(f"if(letter <> '' and substring(word, d + 2, 1) <> letter, concat({before}, {after}), null)"),
        F.expr(f"concat({before}, heavy, {here})"),
    ))).alias("other"))
    met = merged.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    met = stored(met, "met")
    one = met.select("word", F.lit(1).alias("near"), _better(F.col("other_n"), F.col("other")).alias("best"))
    two = met.select(F.col("other").alias("word"), F.lit(1).alias("near"), _better(F.col("n"), F.col("word")).alias("best"))
    key = light.where("letter <> ''").select("word", "n", F.expr(f"concat({before}, '.', {after})").alias("key"))
    # At most LETTERS words have one key; of each, the best of the others is the first or the second of all.
    groups = key.groupBy("key").agg(F.sort_array(F.collect_list(_better(F.col("n"), F.col("word")))).alias("all")).where(F.size("all") > 1)
    each = groups.select(F.posexplode("all").alias("at", "own"), (F.size("all") - 1).alias("near"), F.col("all")[0].alias("a"), F.col("all")[1].alias("b"))
    among = each.select(F.col("own.word").alias("word"), "near", F.when(F.col("at") == 0, F.col("b")).otherwise(F.col("a")).alias("best"))
    found = one.unionByName(two).unionByName(among)
    return found.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form, form_n): the end of each chain of forms, which have no cycles as counts grow along them.

    Each turn doubles the steps taken; counts at least double with each step, so there are few.
    """
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    top = forms.agg(F.max("form_n")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log2(top) + 1))))):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return current


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = 2, damage: int = DAMAGE) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    Words are runs of letters in lower case (A-Z only), of min_length letters and min_count occurrences at least; a letter is taken from a
    run where ``damage`` divides the hash of row and run (0: nowhere).  Words are near that differ by one inserted, deleted or
    replaced code point.  The form is the most frequent near word, of equals the first in code-point order, if it
    is at least ratio (2 or more) times as frequent; the root is the end of the chain of forms.  Null and empty texts have no
    words, repeated rows count as often as they come, an empty table gives an empty result, other columns are not read.
    """
    words = stored(word_counts(docs, id_col, text_col, min_length, min_count, damage), "words")
    near = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.rank") >= ratio * F.col("n"), F.col("best")).alias("best"))
    near = stored(near.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.rank")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form", "form_n"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
