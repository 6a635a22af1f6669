"""Conversation structure repair: weighted error-correcting Earley parsing of role sequences."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, slices, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: The grammar of well-formed conversations, (s?(ua)+)?, with its error productions. Symbols in capitals stand for what
#: lies to the right of a point: Empty (nothing kept), or kept rows that begin with an assistant, user or system row.
#: A conversation is read from its last row to its first. So every production recurses on the left, a chart column
#: holds a few items however long the conversation, and an edit is put before the edits that are already known: audits
#: share their tails, and two of one cost differ in the first edit or not at all.
PRODUCTIONS = [
    ("Root", ("Empty",)),
    ("Root", ("User",)),
    ("Root", ("System",)),
    ("Empty", ()),
    *[(x, (x, "delete")) for x in ("Empty", "Assistant", "User", "System")],
    *[("Assistant", (x, f"{e} a")) for x in ("Empty", "User") for e in ("keep", "rerole", "insert")],
    *[("User", ("Assistant", f"{e} u")) for e in ("keep", "rerole", "insert")],
    ("System", ("User", "keep s")),
]
EDITS = {"keep": "K", "rerole": "R", "delete": "D", "insert": "I"}


def before(x: tuple | None, y: tuple | None) -> bool:
    """Whether the audit ``x`` (edit, rest) is less than ``y`` by code point."""
    while x is not y:
        if x is None or y is None:
            return x is None
        if x[0] != y[0]:
            return x[0] < y[0]
        x, y = x[1], y[1]
    return False


class Earley:
    """A weighted Earley parser whose items keep the least (cost, audit) of all their derivations.

    Terminals are edits: a row offers those that it allows at their costs (scanner), and ``insert`` edits need no row,
    so they advance an item inside its column. Items of a column are taken cheapest first and once more whenever
    a cheaper or equally cheap, smaller audit turns up.
    """

    def __init__(self, productions: list[tuple[str, tuple[str, ...]]], start: str = "Root", insert: int = INSERT):
        self.productions, self.start, self.insert = productions, start, insert
        self.by_head: dict[str, list[int]] = {}
        for k, (head, _) in enumerate(productions):
            self.by_head.setdefault(head, []).append(k)

    def parse(self, rows: Iterable[dict[str, int]]) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair of rows that come from the last to the first."""
        #: For each column, the items in it that wait for a symbol. Columns that none waits in are None.
        self.waits: list[dict[str, list] | None] = []
        column = self._close({(k, 0, 0): (0, None) for k in self.by_head[self.start]})
        for row in rows:
            scanned: dict = {}
            for (k, dot, origin), (cost, audit) in column.items():
                body = self.productions[k][1]
                if dot < len(body) and (price := row.get(body[dot])) is not None:
                    self._better(scanned, (k, dot + 1, origin), (cost + price, (EDITS[body[dot].split()[0]], audit)))
            column = self._close(scanned)
        best = None
        for (k, dot, origin), value in column.items():
            head, body = self.productions[k]
            if head == self.start and origin == 0 and dot == len(body) and (best is None or value[0] < best[0] or (value[0] == best[0] and before(value[1], best[1]))):
                best = value
        out, rest = [], best[1]
        while rest is not None:
            out.append(rest[0])
            rest = rest[1]
        return best[0], "".join(out)

    @staticmethod
    def _better(column: dict, item: tuple, value: tuple) -> bool:
        old = column.get(item)
        if old is None or value[0] < old[0] or (value[0] == old[0] and before(value[1], old[1])):
            column[item] = value
            return True
        return False

    def _close(self, column: dict) -> dict:
        """Predicts, completes and inserts until the column has all its items."""
        at = len(self.waits)
        waits: dict[str, list] = {}
        self.waits.append(waits)
        done: dict[str, tuple] = {}  # symbols that are complete with nothing read
        agenda = [(value[0], n, item) for n, (item, value) in enumerate(column.items())]
        heapq.heapify(agenda)
        n = len(agenda)

        def add(item: tuple, value: tuple) -> None:
            nonlocal n
            if self._better(column, item, value):
                n += 1
                heapq.heappush(agenda, (value[0], n, item))

        while agenda:
            cost, _, item = heapq.heappop(agenda)
            k, dot, origin = item
            value = column[item]
            if cost > value[0]:
                continue
            head, body = self.productions[k]
            if dot == len(body):
                if origin == at:
                    done[head] = value
                for other, theirs in (self.waits[origin] or {}).get(head, ()):
                    add((other[0], other[1] + 1, other[2]), joined(theirs, value))
            elif body[dot] in self.by_head:
                symbol = body[dot]
                waits.setdefault(symbol, []).append((item, value))
                for p in self.by_head[symbol]:
                    add((p, 0, at), (0, None))
                if symbol in done:
                    add((k, dot + 1, origin), joined(value, done[symbol]))
            elif body[dot].startswith("insert"):
                add((k, dot + 1, origin), (value[0] + self.insert, (EDITS["insert"], value[1])))
        if not waits:
            self.waits[at] = None
        return column


def joined(later: tuple, earlier: tuple) -> tuple:
    """The value of an item that goes on over a complete symbol, whose rows stand before the item's own."""
    cost, audit = later[0] + earlier[0], later[1]
    if audit is None:
        return cost, earlier[1]
    edits, rest = [], earlier[1]
    while rest is not None:
        edits.append(rest[0])
        rest = rest[1]
    for e in reversed(edits):
        audit = (e, audit)
    return cost, audit


def offers() -> list[dict[str, int]]:
    """What a row allows, by its class: 3 * (role: system, user, assistant, other) + (sound, truncated, must go)."""
    out = []
    for initial in "sua-":
        for fault in range(3):
            row = {"delete": DELETE}
            if fault < 2:
                if initial != "-":
                    row[f"keep {initial}"] = KEEP + TRUNCATED * fault
                row |= {f"rerole {x}": REROLE + TRUNCATED * fault for x in "ua"}
            out.append(row)
    return out


class Repairer:
    """Repairs of role sequences; those of short conversations are kept, since few differ."""

    def __init__(self, hold: int = 50_000, short: int = 64):
        self.parser, self.offers, self.held, self.hold, self.short = Earley(PRODUCTIONS), offers(), {}, hold, short

    def repair(self, classes: bytes) -> tuple[int, str]:
        if (found := self.held.get(classes)) is None:
            found = self.parser.parse(self.offers[c] for c in reversed(classes))
            if len(classes) <= self.short:
                if len(self.held) >= self.hold:
                    self.held.clear()
                self.held[classes] = found
        return found


class Conversation:
    """What is held of a conversation while its rows pass: a byte a row, and its texts, on disk where they are many."""

    def __init__(self, conv):
        self.conv, self.classes, self.sizes = conv, bytearray(), array("q")
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.last = 0, None
        self.low = self.high = self.seen = None
        self.turns = 0
        self.texts = SpooledTemporaryFile(max_size=8 << 20)  # noqa: SIM115

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.seen
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.seen = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if fault in self.counts:
            self.counts[fault] += 1
        self.classes.append(3 * ("sua".index(initial) if initial in ("s", "u", "a") else 3) + (2 if fault in "bd" else 1 if fault == "t" else 0))
        r, t = role.encode(), text.encode()
        self.sizes.extend((len(r), len(t)))
        self.texts.write(r + t)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def rows(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of the repaired conversation, in order."""
        self.texts.seek(0)
        sizes, last = iter(self.sizes), ""
        for edit in audit:
            role = text = b""
            if edit != "I":
                role = self.texts.read(next(sizes))
                text = self.texts.read(next(sizes))
            if edit == "D":
                continue
            if edit != "K":
                role = b"assistant" if last == "u" else b"user"
            last = role[:1].decode()
            yield edit, role, text


def screened(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column) -> DataFrame:
    """Rows in order inside their conversation: conv, turn, role, text, fault (b, d, t or -), gone.

    One shuffle, by conversation. Earlier rows of the same role and text are counted by a window whose rows Spark spills
    where one conversation holds many.
    """
    r, t = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    mine = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.when(gone, F.lit("")).otherwise(r).alias("role"), F.when(gone, F.lit("")).otherwise(t).alias("text"), gone.alias("gone"))
    earlier = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    core = F.btrim("text", F.lit(SPACES))
    fault = F.when(core == "", "b").when(F.col("nth") > 1, "d").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    dealt = mine.repartition("conv").withColumn("nth", F.row_number().over(earlier)).select("conv", "turn", "role", "text", fault.alias("fault"), "gone")
    return dealt.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


def conversations(batches: Iterator[pa.RecordBatch], at: int = 3) -> Iterator[Conversation]:
    """Whole conversations out of sorted batches (conv, turn, role, text, fault, gone), one at a time."""
    now, begun = None, False
    for batch in slices(batches, at, rows=4096):
        for conv, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != now.conv:
                if begun:
                    yield now
                now, begun = Conversation(conv), True
            if not gone:
                now.add(turn, role, text, fault)
    if begun:
        yield now


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """A row for each conversation: ``conv``, counts of its faults, and the cheapest repair of its role sequence.

    gaps: turns missing between the least and the greatest; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbours whose role initials are not su, ua or au; cost and audit: of the cheapest edits (K keep 0,
    R rerole 1, D delete 2, I insert 5, 5 more for a truncated row that stays; blank and duplicate rows must go) that
    leave role initials ``(s?(ua)+)?``, the least audit by code point among equals; repaired_sha256: of the repaired
    ``role:text``, joined by newlines. ``repaired_rows`` gives those rows themselves.

    Rows where ``gone`` holds are taken as lost: they count nowhere, but their conversation has a row.

    A conversation is read as a stream by one task, because SHA-256 and the parse go through it in order. Held at once:
    about 150 bytes a row, and its texts up to 8 MB, beyond that in a file of the task's own that ends with it.

    Defined cases: null roles and texts count as one space; null turns come first and count in no gap; rows of one turn
    go by role and text; a null conversation is one of its own; rows that repeat are duplicates; a conversation of lost
    rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty table; other columns are
    ignored, whatever their names.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out = Repairer(), []
        for c in conversations(batches):
            cost, audit = repairer.repair(bytes(c.classes))
            digest = hashlib.sha256()
            for n, (_, r, t) in enumerate(c.rows(audit)):
                digest.update((b"\n" if n else b"") + r + b":" + t)
            c.texts.close()
            out.append((c.conv, c.gaps(), c.counts["b"], c.counts["d"], c.counts["t"], c.illegal, cost, audit, digest.hexdigest()))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    kind = rows.schema[conv].dataType.simpleString()
    names = [x.split()[0] for x in REPORT.split(", ")]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(["conv", *names], x, strict=True)) for x in out], schema)

    schema = pa.schema([("conv", arrow_type(rows, conv)), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]])
    found = screened(rows, conv, turn, role, text, F.lit(False) if gone is None else gone).mapInArrow(run, f"conv {kind}, {REPORT}")
    return found.withColumnRenamed("conv", conv)


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired conversations as rows: ``conv``, at (from 0), role, text, edit (K, R or I). Cases as ``repair_report``;
    a conversation that is repaired to nothing has no row."""
    small_batches(rows.sparkSession)
    schema = pa.schema([("conv", arrow_type(rows, conv)), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out, size = Repairer(), [], 0
        for c in conversations(batches):
            for n, (edit, r, t) in enumerate(c.rows(repairer.repair(bytes(c.classes))[1])):
                out.append({"conv": c.conv, "at": n, "role": r.decode(), "text": t.decode(), "edit": edit})
                size += len(r) + len(t)
                if len(out) >= 4096 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            c.texts.close()
        yield pa.RecordBatch.from_pylist(out, schema)

    kind = rows.schema[conv].dataType.simpleString()
    found = screened(rows, conv, turn, role, text, F.lit(False) if gone is None else gone).mapInArrow(run, f"conv {kind}, at long, role string, text string, edit string")
    return found.withColumnRenamed("conv", conv)


def arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults put in by a checksum of ``conv:turn`` modulo 20: 0 loses the row (``gone``), 1 empties
    its text, 2 takes its ``[.!?]`` out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    mine = rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), space(role).alias("r"), space(text).alias("t"), code.alias("code"))
    new_text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    out = mine.select(conv, turn, F.when(F.col("code") == 4, "user").otherwise(F.col("r")).alias(role), new_text.alias(text), (F.col("code") == 0).alias("gone"), "code")
    return out.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code", "copy")
