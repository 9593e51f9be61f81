"""Conversation structure repair by a min-plus scan of matrices.

A repaired conversation is empty, or an optional system turn before pairs of a user and an assistant turn. That is an
automaton of four states: START, after a system turn, after a user turn, after an assistant turn. Each turn is a 4x4
matrix over (cost, audit): entry (i, j) is the cheapest way from state i to state j that inserts any turns and then
keeps, reroles or deletes this one; the audit is the edits' initials, and the least of equal costs. Sums of costs and
concatenated audits make the product associative: audits of equal cost over the same turns are never prefixes of each
other, since what one has beyond the other could only be inserted turns, which cost. So a partition folds its stretch of
a conversation as a tree, and the stretches of a conversation that spans partitions are folded in rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = (1 << 60, "")
#: Turns that are folded one by one before stretches are folded in pairs, and stretches folded in one group.
BLOCK, FAN_IN = 32, 8

Entry = tuple[int, str]
Matrix = list[list[Entry]]


# -- the matrices -------------------------------------------------------------------------------------


def _more(entry: Entry, cost: int, edits: str) -> Entry:
    return (entry[0] + cost, entry[1] + edits) if entry[0] < NEVER[0] else NEVER


def identity() -> Matrix:
    return [[(0, "") if i == j else NEVER for j in range(4)] for i in range(4)]


def inserted(row: list[Entry]) -> list[Entry]:
    """What a row of a matrix reaches with any inserted turns behind it."""
    start, system, user, assistant = row
    put = lambda x, n=1: _more(x, n * INSERT, "I" * n)
    return [start, system, min(user, put(start), put(system), put(assistant)), min(assistant, put(user), put(start, 2), put(system, 2))]


def turned(row: list[Entry], initial: str, fault: str) -> list[Entry]:
    """The row times the matrix of a turn: inserted turns before it, then the turn itself."""
    start, system, user, assistant = row = inserted(row)
    out = [_more(x, DELETE, "D") for x in row]
    if fault in ("blank", "duplicate"):
        return out
    extra = TRUNCATED if fault == "truncated" else 0
    edit = lambda x, role: _more(x, extra, "K") if initial == role else _more(x, REROLE + extra, "R")
    out[2] = min(out[2], edit(min(start, system, assistant), "u"))
    out[3] = min(out[3], edit(user, "a"))
    if initial == "s":
        out[1] = min(out[1], edit(start, "s"))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    reach = range(4)
    return [[min(_more(a[i][k], *b[k][j]) if b[k][j][0] < NEVER[0] else NEVER for k in reach) for j in reach] for i in reach]


def cheapest(matrix: Matrix) -> Entry:
    """From START to an end: nothing, or after an assistant turn."""
    row = inserted(matrix[0])
    return min(row[0], row[3])


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines of a repaired conversation: the audit says what happens to each of the rows (role, text), and what
    comes before says which role a rerole or an inserted turn has."""
    last = ""
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if last == "u" else "user"), ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield f"{role}:{text}"


# -- stretches ----------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated")
_STRETCH = "conv {kind}, part long, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, first_turn long, last_turn long"


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class Stretch:
    """A run of a conversation's turns: its matrix, counts, and what the ends need when it meets others."""

    def __init__(self, matrix: Matrix, blank: int, duplicate: int, truncated: int, illegal: int, first: str, last: str, low: int | None, high: int | None, turns: int, first_turn: int | None, last_turn: int | None):
        self.matrix, self.blank, self.duplicate, self.truncated, self.illegal = matrix, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns, self.first_turn, self.last_turn = first, last, low, high, turns, first_turn, last_turn

    def then(self, b: Stretch) -> Stretch:
        some = lambda f, x, y: y if x is None else x if y is None else f(x, y)
        same = int(b.first_turn is not None and self.last_turn == b.first_turn)  # turns are in order, so equal ones meet here
        return Stretch(
            product(self.matrix, b.matrix), self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated,
            self.illegal + b.illegal + (not legal(self.last, b.first)), self.first, b.last, some(min, self.low, b.low), some(max, self.high, b.high),
            self.turns + b.turns - same, self.first_turn, b.last_turn,
        )

    def values(self) -> list:
        flat = [x for row in self.matrix for x in row]
        return [[x[0] for x in flat], [x[1] for x in flat], self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns, self.first_turn, self.last_turn]

    @staticmethod
    def read(costs: list[int], audits: list[str], *rest) -> Stretch:
        flat = list(zip(costs, audits, strict=True))
        return Stretch([flat[i : i + 4] for i in range(0, 16, 4)], *rest)


class Folder:
    """Turns in order, folded as a tree: stretches of equal height are joined as soon as they meet."""

    def __init__(self):
        self.stack: list[tuple[int, Stretch]] = []
        self.matrix, self.rows = identity(), []

    def add(self, initial: str, fault: str, turn: int | None) -> None:
        self.matrix = [turned(row, initial, fault) for row in self.matrix]
        self.rows.append((initial, fault, turn))
        if len(self.rows) == BLOCK:
            self._close()

    def _close(self) -> None:
        faults = [f for _, f, _ in self.rows]
        known = [t for _, _, t in self.rows if t is not None]
        illegal = sum(not legal(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:], strict=False))
        one = Stretch(self.matrix, *(faults.count(c) for c in COUNTS), illegal, self.rows[0][0], self.rows[-1][0], min(known, default=None), max(known, default=None), len(set(known)), self.rows[0][2], self.rows[-1][2])
        height = 0
        while self.stack and self.stack[-1][0] == height:
            one, height = self.stack.pop()[1].then(one), height + 1
        self.stack.append((height, one))
        self.matrix, self.rows = identity(), []

    def whole(self) -> Stretch:
        if self.rows:
            self._close()
        one = self.stack.pop()[1]
        while self.stack:
            one = self.stack.pop()[1].then(one)
        return one


def _table(rows: list[list], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(like)], schema=like)


def _schema(kind: pa.DataType) -> pa.Schema:
    whole, text = pa.int64(), pa.string()
    kinds = [kind, whole, pa.list_(whole), pa.list_(text), whole, whole, whole, whole, text, text, whole, whole, whole, whole, whole]
    return pa.schema([pa.field(f.split()[0], k) for f, k in zip(_STRETCH.split(", "), kinds, strict=True)])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, initial, fault, turn in order -> a stretch for each conversation."""
    folder, conv, out, like = None, None, [], None
    for batch in batches:
        like = like or _schema(batch.column(0).type)
        for one, initial, fault, turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if folder is None or one != conv:
                if folder is not None:
                    out.append([conv, 0, *folder.whole().values()])
                folder, conv = Folder(), one
            folder.add(initial, fault, turn)
        if len(out) >= 1000:
            yield _table(out, like)
            out = []
    if folder is not None:
        yield _table([*out, [conv, 0, *folder.whole().values()]], like)


def _merge(group: pa.Table) -> pa.Table:
    rows = sorted(zip(*(c.to_pylist() for c in group.columns), strict=True), key=lambda r: r[1])
    one = Stretch.read(*rows[0][2:])
    for r in rows[1:]:
        one = one.then(Stretch.read(*r[2:]))
    return pa.Table.from_batches([_table([[rows[0][0], rows[0][1] // FAN_IN, *one.values()]], group.schema)])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", *COUNTS, "illegal", "cost", "audit"]
    for batch in batches:
        rows = []
        for conv, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = Stretch.read(*values)
            gaps = 0 if s.low is None else s.high - s.low + 1 - s.turns
            rows.append([conv, gaps, s.blank, s.duplicate, s.truncated, s.illegal, *cheapest(s.matrix)])
        kinds = [batch.column(0).type, *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, audit, role, text: a row with the audit before the turns of each conversation -> conv, sha."""

    kind = None

    def rows():
        nonlocal kind
        for batch in batches:
            kind = batch.column(0).type
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    each, out = rows(), []
    row = next(each, None)
    while row is not None:
        conv, audit, after = row[0], row[1], None

        def turns():
            nonlocal after
            for r in each:
                if r[1] is not None:
                    after = r
                    return
                yield r[2], r[3]

        digest, mine, any_line = hashlib.sha256(), turns(), False
        for line in replay(audit, mine):
            digest.update(("\n" if any_line else "").encode() + line.encode())
            any_line = True
        for _ in mine:  # none is left; this reads on to the next conversation
            pass
        out.append((conv, digest.hexdigest()))
        row = after
        if len(out) == 1000 or row is None:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], ["conv", "repaired_sha256"])
            out = []


# -- the operator -------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy: the rows after damage, by the crc32 of conv_id:turn modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    read = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read.where("kind != 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))


def _fault(again: Column) -> Column:
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return F.when(end == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")


def repair(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for rows(conv, turn, role, text, copy).

    Turns are in order of turn (nulls first), ties in order of role, text and copy. A conversation of any length is
    spread over partitions; a partition hands on one stretch of each, and stretches are folded FAN_IN at a time. Only
    the digest needs a conversation's rows in one task, where they stream by, as SHA-256 can't be put together from parts.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text", "copy", "uid"]
    placed = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = settle(placed.select(F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text", said.alias("said")))
    firsts = placed.groupBy("conv", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    judged = placed.select("pos", "conv", "turn", "text", F.substring("role", 1, 1).alias("initial")).join(firsts, "pos", "left")
    judged = judged.select("pos", "conv", "initial", _fault(F.col("new").isNull()).alias("fault"), "turn")
    stretches = judged.repartitionByRange("pos").sortWithinPartitions("pos").select("conv", "initial", "fault", "turn").mapInArrow(_fold, _STRETCH.format(kind=kind))
    stretches = settle(stretches.withColumn("part", F.spark_partition_id().cast("long")))
    done = None
    while True:
        # a conversation that goes on in the next partition: at most one for each border between partitions
        spread = settle(stretches.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select(F.col("conv").alias("wide")))
        near = F.broadcast(spread)
        single = stretches.join(near, F.col("conv").eqNullSafe(F.col("wide")), "left_anti")
        done = single if done is None else done.unionAll(single)
        if not spread.limit(1).count():
            break
        wide = stretches.join(near, F.col("conv").eqNullSafe(F.col("wide")), "left_semi")
        stretches = settle(wide.groupBy("conv", F.floor(F.col("part") / FAN_IN)).applyInArrow(lambda key, group: _merge(group), _STRETCH.format(kind=kind)))
    answers = settle(done.mapInArrow(_answer, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    none = F.lit(None).cast("string")
    text = placed.select("conv", "pos", none.alias("audit"), "role", "text").unionAll(answers.select("conv", F.lit(-1).cast("long"), "audit", none, none))
    text = text.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "audit", "role", "text")
    digests = text.mapInArrow(_repaired, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", "of")
    return answers.join(digests, F.col("conv").eqNullSafe(F.col("of"))).drop("of")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of the table.

    Null ids are one conversation, null turns come first and count in no gap, null roles and texts are one space. Rows
    that repeat come after each other, and all but the first are duplicates. A conversation that loses all its rows has
    zeros, an empty audit and the digest of the empty text; an empty table gives no rows. Only conv_id, turn, role and
    text are read.
    """
    found = repair(damage(conversations))
    every = conversations.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "illegal", "cost")]
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
