"""Conversation structure repair by signatures.

Each row of a conversation is one character: its role's initial (``s``, ``u``, ``a``, else ``o``), in upper case where
the text is cut off, or ``x`` where the row is blank or a copy of an earlier one.  These characters in order
are the conversation's signature.  Edits that make the roles fit ``(s?(ua)+)?`` depend on nothing else, so each distinct
signature is solved once, by memoised recursion over places and states; the audits are joined back to
the conversations and replayed over their rows.

Rows go by conversation and are sorted, and a task reads them as a stream: of a conversation with any number of rows it
holds its signature and audit, a character a row, and the hash so far.  Texts move once, to be replayed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, stored

#: White space of texts.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"

REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

#: States: nothing kept, a system row, a user row, an assistant row.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a user or an assistant row, whichever may stand there, and that row's role.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
ROLE = (USER, USER, ASSISTANT, USER)
#: Edits to reach a valid end: insertions of what is missing.
_ENDING = (0, 2 * INSERT_COST, INSERT_COST, 0)


def _kept(symbol: str, state: int) -> int | None:
    """The state after a row of this symbol is kept."""
    letter = symbol.lower()
    if letter == ROLE[state][0]:
        return NEXT[state]
    return SYSTEM if letter == "s" and state == START else None


def solve(signature: str) -> tuple[int, str]:
    """The least cost of the edits of a signature and their initials, the ASCII-least of equally cheap ones."""
    known: list[tuple[int, ...]] = [_ENDING]

    def rest(place: int, state: int) -> int:
        """The least cost from here on, with what is known of the later places."""
        return known[len(signature) - place][state]

    def without_insert(place: int, state: int) -> list[tuple[str, int, int]]:
        """(edit, cost with all that follows, state after it) for the row at this place."""
        symbol = signature[place]
        out = [("D", DELETE_COST + rest(place + 1, state), state)]
        if symbol != "x":
            cut = TRUNCATED_COST if symbol.isupper() else 0
            if (after := _kept(symbol, state)) is not None:
                out.append(("K", cut + rest(place + 1, after), after))
            out.append(("R", REROLE_COST + cut + rest(place + 1, NEXT[state]), NEXT[state]))
        return out

    # Asked from the last place on, so the recursion is never deeper than one call.
    for place in range(len(signature) - 1, -1, -1):
        cost = [min(x[1] for x in without_insert(place, q)) for q in range(4)]
        for _ in range(3):
            cost = [min(c, INSERT_COST + cost[NEXT[q]]) for q, c in enumerate(cost)]
        known.append(tuple(cost))
    total, place, state = rest(0, START), 0, START
    audit = []
    while place < len(signature) or rest(place, state):
        left = rest(place, state)
        choice = [("I", INSERT_COST + rest(place, NEXT[state]), NEXT[state])]
        if place < len(signature):
            choice += without_insert(place, state)
        edit, _, state = min(x for x in choice if x[1] == left)
        audit.append(edit)
        place += edit != "I"
    return total, "".join(audit)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by a hash of conversation and turn; ``gone`` marks dropped ones."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col))) % 20
    role, text = one("role"), one("text")
    return rows.select(
        conv_col, turn_col,
        F.when(draw == 4, USER).otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        (draw == 0).alias("gone"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, tie, gone, initial, symbol) of rows (conv, turn, role, text, gone)."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = rows.select(
        "conv", "turn", "role", F.md5("text").alias("tie"), "gone", initial.alias("initial"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    return marked.repartition("conv").selectExpr(
        "*",
        "row_number() OVER (PARTITION BY conv, gone, role, tie ORDER BY turn) > 1 AS again",
    ).select(
        "conv", "turn", "role", "tie", "gone", "initial",
        F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial")).alias("symbol"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches that are bounded in rows and in characters."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_LINKS = ("su", "ua", "au")


def _signed(conv, rows: Iterator[tuple]) -> tuple:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of sorted rows (conv, turn, gone, initial, symbol)."""
    signature: list[str] = []
    count = dict.fromkeys("bdt", 0)
    first = last = before = None
    turns = illegal = 0
    for _, turn, gone, initial, symbol in rows:
        if gone:
            continue
        if turn is not None:
            first = turn if first is None else first
            turns += turn != last
            last = turn
        illegal += before is not None and before + initial not in _LINKS
        before = initial
        kind = "t" if symbol.isupper() else symbol
        if kind in count:
            count[kind] += 1
        signature.append("x" if symbol in "bd" else symbol)
    gaps = 0 if first is None else last - first + 1 - turns
    return conv, "".join(signature), gaps, count["b"], count["d"], count["t"], illegal


def _named(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"),
    )


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are (id, turn, role, text), in the order of their turns, nulls first; rows of one turn by role, then by the MD5 of their
    text.  Null roles and texts are one space, null ids are one conversation.  Rows that are marked as gone
    (column ``gone``) count only for their conversation to be returned, with zeros and an empty audit where all
    are.  An empty table gives an empty result, other columns are not read.
    """
    kind = rows.schema[conv_col].dataType
    symbols = _symbols(_named(rows, conv_col, turn_col)).sortWithinPartitions("conv", "turn", "role", "tie", F.col("symbol") == "d")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("signature", pa.string()), *((c, pa.int64()) for c in counts)])
            groups = groupby(_rows(_chain(batch, batches)), key=itemgetter(0))
            yield from _batches((_signed(k, own) for k, own in groups), schema)

    shape = f"conv {kind.simpleString()}, signature string, " + ", ".join(f"{c} long" for c in counts)
    signed = stored(symbols.select("conv", "turn", "gone", "initial", "symbol").mapInArrow(sign, shape), "signatures")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(s) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=["signature", "cost", "audit"])

    # Stored, so that Spark knows its size: it goes to every task if it is small, and else hot signatures are split.
    answers = stored(signed.select("signature").distinct().mapInArrow(solved, "signature string, cost long, audit string"), "audits")
    found = signed.join(answers, "signature")
    return found.select(F.col("conv").alias(conv_col), *counts, "cost", "audit")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _replayed(conv, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv, place, edit, turn, role, text) after the edits; the first row holds the audit."""
    audit, state, place = next(rows)[5] or "", START, 0
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)[2:5]
        if edit == "D":
            continue
        after = _kept(role[:1], state) if edit == "K" else None
        role = role if edit == "K" else ROLE[state]
        state = NEXT[state] if after is None else after
        yield conv, place, edit, turn, role, text
        place += 1
    for _ in rows:
        pass


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows that the audits leave: id, place, edit (K, R or I), turn (null where inserted), role, text.

    A conversation's rows lie in one partition, in the order of their places.  ``found`` is what :func:`audits` made of these rows.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    own = _named(rows, conv_col, turn_col).where(~F.col("gone"))
    own = own.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select(
        F.col(conv_col).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("text"), "audit",
    )
    dealt = heads.unionByName(own).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", F.md5("text"))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("place", pa.int64()), ("edit", pa.string()),
                                ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            groups = groupby(_rows(_chain(batch, batches)), key=itemgetter(0))
            yield from _batches((x for k, own in groups for x in _replayed(k, own)), schema)

    out = dealt.mapInArrow(replay, f"conv {kind}, place long, edit string, turn long, role string, text string")
    return out.withColumnRenamed("conv", conv_col)


def digests(fixed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256) of what :func:`repaired` returns: the hash of ``role:text`` of each row, joined by newlines."""
    kind = fixed.schema[conv_col].dataType.simpleString()

    def hashed(conv, rows: Iterator[tuple]) -> tuple:
        state = hashlib.sha256()
        for k, (_, role, text) in enumerate(rows):
            state.update((("\n" if k else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return conv, state.hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("repaired_sha256", pa.string())])
            groups = groupby(_rows(_chain(batch, batches)), key=itemgetter(0))
            yield from _batches((hashed(k, own) for k, own in groups), schema)

    rows = fixed.select(F.col(conv_col).alias("conv"), "role", "text")
    return rows.mapInArrow(digest, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The columns of :func:`audits` and the hash of the repaired conversation, that of nothing where no row is left."""
    found = stored(audits(rows, conv_col, turn_col), "repairs")
    other = free_name("other", found)
    hashes = digests(repaired(rows, found, conv_col, turn_col), conv_col).withColumnRenamed(conv_col, other)
    joined = found.join(hashes, F.col(conv_col).eqNullSafe(F.col(other)), "left").drop(other)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
