"""Conversation structure repair: error-correcting Earley parsing.

A conversation is well formed if the first letters of its roles read
`(s?(ua)+)?`. The grammar is left linear, so every Earley item starts at the
conversation's first row and a chart column holds a fixed number of items:

    empty  ->                          system -> empty s
    asked  -> empty u | system u | answered u
    answered -> asked a                goal   -> empty | answered

Error productions, each with its cost, make every conversation parse: a symbol
u or a matches a row of any role (Rerole) or no row (Insert), and every
nonterminal may swallow a row (Delete). An item retains its least (cost, audit);
the completed goal in the last column gives the repair. The audit is the edits'
letters in order (K, R, D, I); a tie goes to the audit that is least in ASCII.

In Spark: one shuffle finds the (role, text) pairs that a conversation holds in
more than one turn, grouped before it moves; rows are then dealt by conversation,
sorted within their task and parsed in one pass. That pass holds one chart
column, with a running hash of the repaired text in each item, never a
conversation's rows: memory for a conversation of any length is its audit. A
single conversation is one task's work, as the hash of its repaired text can
only be taken in order.

Defined cases: null roles and texts are one space, null turns come first, null
conversation ids are one conversation; rows of one turn are ordered by role,
then text, so repeated rows are adjacent and all but the first are duplicates;
an empty role has no first letter and is never kept; very long texts are hashed
as they stream by; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from siltstone.llm._store import read_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: (what a production makes, what it extends, the symbol it adds).
PRODUCTIONS = (("system", "empty", "s"), ("asked", "empty", "u"), ("asked", "system", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
GOAL = ("empty", "answered")
LEGAL = {"su", "ua", "au"}
#: Rows after which audits are cut into a shared part and a short end.
CUT_ROWS = 256


class Item:
    """A completed nonterminal: its cost, its audit (a frozen head, ranked among its column's, and an end), the hash of its text."""

    __slots__ = ("before", "cost", "head", "piece", "rank", "sha", "system", "tail")

    def __init__(self, cost: int, rank: int, tail: str, head: tuple | None, before: Item | None, piece: bytes | None, system: bool):
        self.cost, self.rank, self.tail, self.head, self.before, self.piece, self.system, self.sha = cost, rank, tail, head, before, piece, system, None

    def then(self, cost: int, letter: str, piece: bytes | None = None, system: bool = False) -> Item:
        return Item(self.cost + cost, self.rank, self.tail + letter, self.head, self, piece, self.system or system)

    def less(self, other: Item | None) -> bool:
        return other is None or (self.cost, self.rank, self.tail) < (other.cost, other.rank, other.tail)

    def hashed(self):
        """The hash of the text so far; what led here is let go."""
        if self.sha is None:
            self.sha = self.before.hashed()
            if self.piece is not None:
                self.sha = self.sha.copy()
                self.sha.update(self.piece)
            self.before = self.piece = None
        return self.sha

    def audit(self) -> str:
        parts, head = [self.tail], self.head
        while head:
            head, part = head
            parts.append(part)
        return "".join(reversed(parts))


class Chart:
    """The Earley chart of one conversation; only its last column is kept."""

    def __init__(self):
        start = Item(0, 0, "", None, None, None, False)
        start.sha = hashlib.sha256()
        self.column: dict[str, Item] = {}
        self.rows = 0
        self._close({"empty": start})

    def _close(self, column: dict[str, Item]) -> None:
        """Complete: symbols matched by no row. Every insertion costs, so this ends."""
        agenda = list(column)
        while agenda:
            made = agenda.pop(0)
            for target, source, symbol in PRODUCTIONS:
                if source == made and symbol in ROLES:
                    item = column[made].then(INSERT, "I", _line(source, ROLES[symbol], b""))
                    if item.less(column.get(target)):
                        column[target] = item
                        agenda.append(target)
        for item in column.values():
            item.hashed()
        self.column = column

    def scan(self, role: str, text: bytes, only_delete: bool, truncated: bool) -> None:
        """One row: deleted by every item, kept or re-roled where a production waits for its symbol."""
        new: dict[str, Item] = {name: item.then(DELETE, "D") for name, item in self.column.items()}
        if not only_delete:
            more, initial = TRUNCATED if truncated else 0, role[:1]
            for target, source, symbol in PRODUCTIONS:
                before = self.column.get(source)
                if before is None:
                    continue
                if symbol == initial:
                    item = before.then(KEEP + more, "K", _line(source, role, text), source == "empty" and symbol == "s")
                    if item.less(new.get(target)):
                        new[target] = item
                if symbol in ROLES:
                    item = before.then(REROLE + more, "R", _line(source, ROLES[symbol], text))
                    if item.less(new.get(target)):
                        new[target] = item
        self._close(new)
        self.rows += 1
        if self.rows % CUT_ROWS == 0:
            self._cut()

    def _cut(self) -> None:
        """Freeze the audits up to their last row. They hold a letter for each row and end in one, so no one is the start of another and their order among themselves settles every later tie."""
        ends = {name: item.tail.rstrip("I") for name, item in self.column.items()}
        order = {key: i for i, key in enumerate(sorted({(item.rank, ends[name]) for name, item in self.column.items()}))}
        for name, item in self.column.items():
            end = ends[name]
            item.head, item.rank, item.tail = (item.head, end), order[item.rank, end], item.tail[len(end) :]

    def best(self) -> Item:
        found = None
        for name in GOAL:
            item = self.column.get(name)
            if item is not None and item.less(found):
                found = item
        return found


def _line(source: str, role: str, text: bytes) -> bytes:
    return b"%s%s:%s" % (b"" if source == "empty" else b"\n", role.encode(), text)


class Conversation:
    """Counts and chart of one conversation, row by row."""

    def __init__(self):
        self.chart = Chart()
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.last, self.initial = None, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        raw, last = text.encode(), (turn, role, text)
        bare = raw.strip()
        blank, duplicate = not bare, seen or last == self.last
        truncated = not blank and not duplicate and bare[-1:] not in (b".", b"!", b"?")
        for i, fault in enumerate((blank, duplicate and not blank, truncated)):
            self.counts[i] += fault
        self.counts[3] += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.last, self.initial = last, role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.chart.scan(role, raw, blank or duplicate, truncated)

    def verdict(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        best = self.chart.best()
        return gaps, *self.counts, best.cost, best.audit(), best.sha.hexdigest(), best.system


VERDICT = [StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField("audit", StringType()), StructField("repaired_sha256", StringType()), StructField("opens_with_system", BooleanType())]


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, any_, done = None, None, False, []

        def told() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[] for _ in schema]
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for key, present, turn, role, text, seen in zip(*(batch.column(c).to_pylist() for c in ("key", "present", "turn", "role", "text", "seen")), strict=True):
                if not any_ or key != at:
                    if any_:
                        done.append((at, *now.verdict()))
                    now, at, any_ = Conversation(), key, True
                if present:
                    now.row(turn, role, text, seen)
            if done:
                yield told()
        if any_:
            done.append((at, *now.verdict()))
            yield told()

    return run


def _rows(turns: DataFrame, key: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(key).alias("key"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))


def repair_conversations(turns: DataFrame, key: str = "conv_id", conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of (key, turn, role, text): faults, cost, audit and the hash of the repaired `role:text` lines.

    `conversations` may name ids (in its column `key`) that are reported even if no turn of theirs is left.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _rows(turns, key).withColumn("digest", F.md5(F.col("text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.groupBy("key", "role", "digest").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most")
    again = again.select(F.col("key").alias("key2"), F.col("role").alias("role2"), F.col("digest").alias("digest2"), "least")
    joined = rows.join(again, F.col("key").eqNullSafe(F.col("key2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2")), "left")
    told = joined.select("key", F.lit(True).alias("present"), "turn", "role", "text", F.coalesce(place > F.col("least"), F.lit(False)).alias("seen"))
    if conversations is not None:
        named = conversations.select(F.col(key).cast(rows.schema["key"].dataType).alias("key")).distinct()
        told = told.unionByName(named.select("key", F.lit(False).alias("present")), allowMissingColumns=True)
    ordered = told.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")
    schema = StructType([StructField(key, rows.schema["key"].dataType), *VERDICT])
    return ordered.mapInArrow(_parse(to_arrow_schema(schema)), schema)


def repaired_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The repaired conversations themselves: (key, position, edit, role, text), positions from 0, edits K, R or I."""
    verdict = repair_conversations(turns, key)
    along = Window.partitionBy("key").orderBy("at")
    letters = verdict.filter("audit <> ''").select(F.col(key).alias("key"), "opens_with_system", F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).over(along)
    letters = letters.select("key", "opens_with_system", "edit", count(F.col("edit") != "I").alias("r"), (count(F.col("edit") != "D") - 1).alias("position")).filter("edit <> 'D'")
    numbered = _rows(turns, key).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    numbered = numbered.select(F.col("key").alias("key2"), F.col("r").cast("long").alias("r2"), "role", "text")
    out = letters.join(numbered, F.col("key").eqNullSafe(F.col("key2")) & (F.col("r") == F.col("r2")) & (F.col("edit") != "I"), "left")
    turn = F.when((F.col("position") % 2 == 1) == F.col("opens_with_system"), ROLES["u"]).otherwise(ROLES["a"])
    return out.select(F.col("key").alias(key), "position", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with damage done by crc32("conv_id:turn") % 20, and the conversations that lost a turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    lost = rows.filter("kind = 0").select("conv_id")
    rows = rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy"), lost


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lost = damaged(read_table(spark, sf_dir, "conversations"))
    return repair_conversations(turns, conversations=lost).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
