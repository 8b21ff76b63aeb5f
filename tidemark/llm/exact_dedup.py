"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed size.  The distinct blocks are sorted and numbered, so a
block becomes an integer name; then names of adjacent blocks are paired, the distinct pairs sorted
and numbered in turn, until one name is left for each document.  Names of one level are equal if and
only if what they stand for is equal, so the last one identifies the whole text without collisions.

Only the first numbering moves text, and it moves each distinct block of an input partition once:
copies collapse before the shuffle, so a group with a third of all rows is no larger than any other
block there.  Everything after it moves integers and hashes; rows meet the names and groups that they
share in joins of two stored tables, whose hot keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE_CLASS, dropped, free_name, noted, stored, text_of

BLOCK_BYTES = 8192


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(text_of(text), SPACE_CLASS + "+", " ")


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, sha, m, idx, block): the m blocks of each row, an empty text having one empty block."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = norm.select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").cast("binary").alias("raw"))
    rows = rows.withColumn("m", F.greatest(F.lit(1), F.ceil(F.length("raw") / size)).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda i: F.struct(i.alias("idx"), F.substring("raw", i * size + 1, F.lit(size)).alias("block")),
    )
    rows = rows.select("id", "sha", "m", F.explode(cut).alias("b"))
    return rows.select("id", "sha", "m", F.col("b.idx").alias("idx"), F.col("b.block").alias("block"))


def _numbered(distinct: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Sort the distinct keys of each partition and number them; stored, so that the names stay."""
    named = distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return stored(named, label)


def _first_names(blocks: DataFrame) -> DataFrame:
    """(id, sha, m, idx, name): each block's integer.

    Blocks travel back to their documents by a 64-bit hash.  A hash that stands for two different
    blocks is found in the numbered table, and its blocks are then named by their bytes.
    """
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    sorted_blocks = hashed.select("h", "block").distinct().sortWithinPartitions("h", "block")
    names = stored(sorted_blocks.select("h", F.monotonically_increasing_id().alias("name")), "blocks")
    shared = names.groupBy("h").count().where("count > 1").select("h")
    keyed = hashed.select("id", "sha", "m", "idx", "h")
    if shared.isEmpty():
        return keyed.join(names, "h").drop("h")
    own = hashed.join(shared, "h", "left_semi")
    exact = _numbered(own.select("h", "block").distinct(), ["h", "block"], "ambiguous")
    exact = own.join(exact, ["h", "block"]).select("id", "sha", "m", "idx", (-1 - F.col("name")).alias("name"))
    rest = keyed.join(shared, "h", "left_anti").join(names, "h").drop("h")
    return rest.unionByName(exact)


def exact_identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, sha, copies, level, name): (level, name) is equal exactly where normalised texts are.

    Rows that repeat both id and text are one row here, with their number in copies.
    """
    level = 0
    with noted() as made:
        named = _first_names(_blocks(docs, id_col, text_col, block_bytes))
        # Equal (id, sha, idx) are repeated rows; they carry equal names.
        named = named.groupBy("id", "sha", "m", "idx").agg(F.max("name").alias("name"), F.count("*").alias("copies"))
        current = stored(named, "names")
    dropped(*(t for t in made if t is not current))
    done = current.where("m = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name")
    longest = current.agg(F.max("m")).first()[0] or 1
    while longest > 1:
        level += 1
        even = F.col("idx") % 2 == 0
        with noted() as made:
            pairs = stored(
                current.where("m > 1")
                .groupBy("id", "sha", "m", F.floor(F.col("idx") / 2).cast("int").alias("idx"))
                .agg(
                    F.max(F.when(even, F.struct("name"))).alias("a"),
                    F.max(F.when(~even, F.struct("name"))).alias("b"),
                    F.max("copies").alias("copies"),
                )
                .select("id", "sha", "m", "idx", "copies", F.col("a.name").alias("a"),
                        F.coalesce("b.name", F.lit(0)).alias("b"), F.col("b").isNull().alias("alone")),
                "pairs",
            )
            names = _numbered(pairs.select("alone", "a", "b").distinct(), ["alone", "a", "b"], "pair-names")
            current = stored(
                pairs.join(names, ["alone", "a", "b"]).select(
                    "id", "sha", F.ceil(F.col("m") / 2).cast("int").alias("m"), "idx", "name", "copies"
                ),
                "names",
            )
        dropped(*(t for t in made if t is not current))
        done = done.unionByName(
            current.where("m = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name")
        )
        longest = (longest + 1) // 2
    return done


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space.  Of equal texts the
    smallest id stays; a null id stays only in a group without any other id.  Rows that repeat id and
    text are returned as often as they come, one of them kept.  An empty table gives an empty result,
    a null text counts as empty, other columns are not read.
    """
    ids = exact_identities(docs, id_col, text_col, block_bytes)
    groups = ids.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Stored, so that both sides of the join come straight from a shuffle and Spark splits a large group's.
    rows = ids.join(stored(groups, "groups"), ["level", "name"])
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that :func:`exact_dedup` keeps.

    The kept (id, hash) pairs are joined back; rows that repeat id and text come down to one.
    """
    key = lambda i, sha: F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), sha))
    own = free_name("row_key", docs)
    verdict = exact_dedup(docs, id_col, text_col).where("kept")
    verdict = verdict.select(key(F.col(id_col), F.col("text_sha256")).alias(own))
    keyed = docs.withColumn(own, key(F.col(id_col), F.sha2(normalised(text_col), 256)))
    # One key for both, so that the second step finds the rows where the join has brought them.
    return keyed.join(verdict, own, "left_semi").dropDuplicates([own]).drop(own)
