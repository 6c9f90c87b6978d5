"""Conversation structure repair: generalised LR parsing of a damaged dialogue's roles, with weighted edits.

Roles must spell ``(s?(ua)+)?`` by their initials. The tables of an LR automaton are built from that grammar. Every row may be kept, given another
role or deleted, and messages may be inserted anywhere, so many stacks are alive at once: a graph-structured stack, of which each level holds one
node for each stack top. Equal tops are merged by minimum (cost, audit), the audit being the edits' initials.
Merging loses nothing: with equal tops the same roles can follow, and of two different audits of the same rows and cost none begins with the other
(each has one letter a row besides its insertions, and its letters fix its cost), so what follows can't turn their order round.

For the same reason levels compose. A conversation of usual length is one segment, parsed and rendered by one task that streams its partition.
Longer ones (``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters) are cut into segments along running sums; each is parsed from every stack top to every other, one streaming
pass chains the segments' results, and segments are rendered apart from each other. Only SHA-256, which has no parallel form, streams a conversation's repaired bytes through
one task, a segment at a time.

Defined results: nulls of role and text are one space, in ``conv_id:turn`` too; null turns come first; rows of equal turn are ordered by role, then text,
repeats adjacent; rows without ``conv_id`` are one conversation. An empty role has no initial, so it can't be kept. Other columns are not read; no rows give none.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, meet, passing, rows_with, rows_without, running, table

#: The role grammar: a dialogue is nothing, turns, or a system message and turns; turns are pairs of user and assistant.
GRAMMAR = (("dialogue", ()), ("dialogue", ("turns",)), ("dialogue", ("s", "turns")), ("turns", ("pair",)), ("turns", ("turns", "pair")), ("pair", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows and characters of a conversation's segment, at most (one row at least).
SEGMENT_ROWS, SEGMENT_CHARS = 1_000, 4_000_000
_ORDER = ["turn", "role", "text"]
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = {"su", "ua", "au"}

Stack = tuple[int, ...]
#: A stack top's node: cost and audit of the cheapest edits that lead to it, and the stack below.
Tops = dict[int, tuple[int, str, Stack]]


class Automaton:
    """LR tables of ``GRAMMAR``: item sets are states; a state whose only item is complete reduces at once."""

    def __init__(self) -> None:
        first = self._closed({(k, 0) for k, (left, _) in enumerate(GRAMMAR) if left == "dialogue"})
        self.states, self.goto = [first], {}
        for items in self.states:
            for symbol in sorted({GRAMMAR[k][1][dot] for k, dot in items if dot < len(GRAMMAR[k][1])}):
                target = self._closed({(k, dot + 1) for k, dot in items if dot < len(GRAMMAR[k][1]) and GRAMMAR[k][1][dot] == symbol})
                if target not in self.states:
                    self.states.append(target)
                self.goto[self.states.index(items), symbol] = self.states.index(target)
        self.reduce = {n: k for n, items in enumerate(self.states) if len(items) == 1 for k, dot in items if dot == len(GRAMMAR[k][1]) and GRAMMAR[k][0] != "dialogue"}
        self.accepts = {n for n, items in enumerate(self.states) for k, dot in items if GRAMMAR[k][0] == "dialogue" and dot == len(GRAMMAR[k][1])}
        #: A stack for each top that a level can hold, the first found of the finitely many stacks. What may follow a stack depends on its top alone.
        self.entries: dict[int, Stack] = {}
        stacks: list[Stack] = [(0,)]
        for stack in stacks:
            self.entries.setdefault(stack[-1], stack)
            stacks += [x for c in "sua" if (x := self.shift(stack, c)) and x not in stacks]

    @staticmethod
    def _closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        while more := {(j, 0) for k, dot in items if dot < len(GRAMMAR[k][1]) for j, (left, _) in enumerate(GRAMMAR) if left == GRAMMAR[k][1][dot]} - items:
            items = items | more
        return frozenset(items)

    @functools.cache
    def shift(self, stack: Stack, initial: str) -> Stack | None:
        """The stack after a role and all reductions that follow it; None where the role can't stand."""
        if (stack[-1], initial) not in self.goto:
            return None
        stack = (*stack, self.goto[stack[-1], initial])
        while (k := self.reduce.get(stack[-1])) is not None:
            left, right = GRAMMAR[k]
            stack = stack[: -len(right)]
            stack = (*stack, self.goto[stack[-1], left])
        return stack


@functools.cache
def automaton() -> Automaton:
    return Automaton()


class Segment:
    """Successive rows of one conversation: (turn, role, text, copies, seen before), parsed from the stacks given, all of them for a cut conversation."""

    def __init__(self, key, conv_id, whole: bool = True):
        self.key, self.conv_id, self.lr = key, conv_id, automaton()
        self.levels: dict[int, Tops] = {e: self._inserted({e: (0, "", s)}) for e, s in self.lr.entries.items() if not whole or e == 0}
        self.rows: list[tuple[str, str, int]] = []
        self.seen: set[tuple[str, str]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def _merge(self, into: Tops, cost: int, audit: str, stack: Stack) -> bool:
        held = into.get(stack[-1])
        if held is None or (cost, audit) < held[:2]:
            into[stack[-1]] = cost, audit, stack
            return True
        return False

    def _inserted(self, tops: Tops) -> Tops:
        """The level with all insertions that lead to a new or cheaper top."""
        changed = list(tops)
        while changed:
            top = changed.pop()
            cost, audit, stack = tops[top]
            for c in ROLES:
                if (x := self.lr.shift(stack, c)) and self._merge(tops, cost + INSERT, audit + "I", x):
                    changed.append(x[-1])
        return tops

    def _read(self, tops: Tops, initial: str, gone: bool, extra: int, copies: int) -> Tops:
        """The next level: the first copy is kept, reroled or deleted, all others are deleted."""
        out: Tops = {}
        rest = "D" * (copies - 1)
        again = DELETE * (copies - 1)
        for cost, audit, stack in tops.values():
            self._merge(out, cost + DELETE + again, audit + "D" + rest, stack)
            if not gone:
                if x := self.lr.shift(stack, initial):
                    self._merge(out, cost + extra + again, audit + "K" + rest, x)
                for c in ROLES:
                    if x := self.lr.shift(stack, c):
                        self._merge(out, cost + REROLE + extra + again, audit + "R" + rest, x)
        return self._inserted(out)

    def add(self, turn, role: str, text: str, copies: int, seen: bool) -> None:
        solid = text.rstrip(_SPACE)
        blank = not solid
        duplicate = not blank and (seen or (role, text) in self.seen)
        truncated = not blank and not duplicate and solid[-1] not in ".!?"
        self.seen.add((role, text))
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - 1 + duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += copies - 1
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.rows.append((role, text, copies))
        self.levels = {e: self._read(tops, initial, blank or duplicate, TRUNCATED * truncated, copies) for e, tops in self.levels.items()}

    def best(self) -> tuple[int, str]:
        return min(x[:2] for top, x in self.levels[0].items() if top in self.lr.accepts)


def rendered(rows: Iterable[tuple[str, str, int]], audit: str, entry: int) -> bytes | None:
    """``role:text`` lines of the rows repaired by ``audit``, from a stack top on; None without any."""
    lr, stack, lines = automaton(), automaton().entries[entry], []
    each = ((role, text) for role, text, copies in rows for role, text in [(role, text)] * copies)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(each)
        if edit == "D":
            continue
        if edit in "IR":
            role = next(name for c, name in ROLES.items() if lr.shift(stack, c))
        stack = lr.shift(stack, role[0])
        lines.append(f"{role}:{text}")
    return "\n".join(lines).encode() if lines else None


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, key, turn, role, text, copies: rows after damage by crc32(conv_id:turn) % 20; a dropped row stays with 0 copies, to name its conversation."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    stays = lambda c: F.when(fate != 0, c)
    role = F.when(fate == 4, "user").otherwise(or_space("role"))
    return conversations.select("conv_id", key.alias("key"), stays(F.col("turn").cast("long")).alias("turn"), stays(role).alias("role"), stays(text).alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def _segments(batches: Iterator[pa.RecordBatch], by: list[str], whole: bool) -> Iterator[tuple[Segment, tuple]]:
    """Segments of sorted rows, one in memory at a time, and what names them."""
    held, segment = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*by, "conv_id", "turn", "role", "text", "copies")] + [batch.column("seen").to_pylist() if "seen" in batch.schema.names else [False] * batch.num_rows]
        for *name, conv_id, turn, role, text, copies, seen in zip(*columns, strict=True):
            if name != held:
                if segment:
                    yield segment, tuple(held)
                held, segment = name, Segment(name[0], conv_id, whole)
            if copies:
                segment.add(turn, role, text, copies, seen)
    if segment:
        yield segment, tuple(held)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 100 + sum(len(x) for x in row if isinstance(x, str | bytes))
        if chars > most:
            yield _emit(held, names, types)
            held, chars = [], 0
    if held:
        yield _emit(held, names, types)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _gaps(first, last, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of one segment: a shuffle by conversation, then one pass over sorted rows."""
    kind, named = rows.schema["conv_id"].dataType.simpleString(), _arrow_type(rows, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for s, _ in _segments(batches, ["key"], whole=True):
                cost, audit = s.best()
                text = rendered(s.rows, audit, 0) or b""
                yield s.conv_id, _gaps(s.first_turn, s.last_turn, s.distinct), s.blank, s.duplicate, s.truncated, s.illegal, cost, audit, hashlib.sha256(text).hexdigest()

        yield from _in_batches(each(), ["conv_id", *_COUNTS, "audit", "repaired_sha256"], [named, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()])

    return rows.repartition("key").sortWithinPartitions("key", *_ORDER).mapInArrow(run, f"conv_id {kind}, {_RESULT}, repaired_sha256 string")


_PART = "key string, segment long, blank long, duplicate long, truncated long, illegal long, distinct_turns long, first_turn long, last_turn long, first_initial string, last_initial string, paths array<struct<entry:int,top:int,cost:long,audit:string>>"


def _parsed(rows: DataFrame) -> DataFrame:
    """A row for each segment: its counts, and the cheapest edits from each stack top to each other."""
    path = pa.list_(pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PART.split(", ")]
        types = [pa.string(), *[pa.int64()] * 8, pa.string(), pa.string(), path]
        for s, (key, segment) in _segments(batches, ["key", "segment"], whole=False):
            paths = [{"entry": e, "top": t, "cost": c, "audit": a} for e, tops in s.levels.items() for t, (c, a, _) in tops.items()]
            yield _emit([(key, segment, s.blank, s.duplicate, s.truncated, s.illegal, s.distinct, s.first_turn, s.last_turn, s.first_initial, s.last_initial, paths)], names, types)

    return rows.repartition("key", "segment").sortWithinPartitions("key", "segment", *_ORDER).mapInArrow(run, _PART)


class _Chain:
    """The segments of one conversation, one after the other."""

    def __init__(self, key: str):
        self.key, self.lr = key, automaton()
        self.counts = [0, 0, 0, 0]
        self.distinct, self.first, self.last, self.initial = 0, None, None, None
        # top -> cost, audit, and a linked list of (earlier, segment, entry, length of the segment's audit)
        self.tops: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}

    def add(self, r: dict) -> None:
        self.counts = [a + r[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if r["first_initial"] is not None:
            if self.initial is not None and self.initial + r["first_initial"] not in _LEGAL:
                self.counts[3] += 1
            self.initial = r["last_initial"]
        if r["first_turn"] is not None:
            self.distinct += r["distinct_turns"] - (self.last == r["first_turn"])
            self.first, self.last = r["first_turn"] if self.first is None else self.first, r["last_turn"]
        tops: dict[int, tuple[int, str, tuple | None]] = {}
        for p in r["paths"]:
            if p["entry"] in self.tops:
                cost, audit, link = self.tops[p["entry"]]
                cost += p["cost"]
                held = tops.get(p["top"])
                if held is None or (cost, audit + p["audit"]) < held[:2]:
                    tops[p["top"]] = cost, audit + p["audit"], (link, r["segment"], p["entry"], len(p["audit"]))
        self.tops = tops

    def rows(self) -> Iterator[tuple]:
        """One row with the conversation's results (no segment), then one with each segment's edits."""
        cost, audit, link = min((x for top, x in self.tops.items() if top in self.lr.accepts), key=lambda x: x[:2])
        yield self.key, None, None, _gaps(self.first, self.last, self.distinct), *self.counts, cost, audit
        end = len(audit)
        while link:
            link, segment, entry, n = link
            yield self.key, segment, entry, *[None] * len(_COUNTS), audit[end - n : end]
            end -= n


def _chained(parsed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            chain = None
            for batch in batches:
                for k in range(batch.num_rows):
                    (r,) = batch.slice(k, 1).to_pylist()
                    if chain is None or chain.key != r["key"]:
                        if chain:
                            yield from chain.rows()
                        chain = _Chain(r["key"])
                    chain.add(r)
            if chain:
                yield from chain.rows()

        yield from _in_batches(each(), ["key", "segment", "entry", *_COUNTS, "audit"], [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * len(_COUNTS), pa.string()])

    return parsed.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(run, f"key string, segment long, entry int, {_RESULT}")


def _hashed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """key, repaired_sha256: segments are rendered apart from each other, then each conversation's bytes stream through one hash."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held, own, plan = None, [], None
            for batch in batches:
                for key, segment, role, text, copies, audit, entry in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "role", "text", "copies", "audit", "entry")), strict=True):
                    if (key, segment) != held:
                        if held:
                            yield *held, rendered(own, *plan)
                        held, own, plan = (key, segment), [], (audit, entry)
                    if copies:
                        own.append((role, text, copies))
            if held:
                yield *held, rendered(own, *plan)

        yield from _in_batches(each(), ["key", "segment", "bytes"], [pa.string(), pa.int64(), pa.binary()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held, sha, begun = None, None, False
            for batch in batches:
                for key, part in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    if key != held:
                        if held is not None:
                            yield held, sha.hexdigest()
                        held, sha, begun = key, hashlib.sha256(), False
                    if part is not None:
                        sha.update(b"\n" * begun + part)
                        begun = True
            if held is not None:
                yield held, sha.hexdigest()

        yield from _in_batches(each(), ["key", "repaired_sha256"], [pa.string(), pa.string()])

    pieces = rows.join(edits, ["key", "segment"]).repartition("key", "segment").sortWithinPartitions("key", "segment", *_ORDER).mapInArrow(render, "key string, segment long, bytes binary")
    return pieces.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(digest, "key string, repaired_sha256 string")


def _cut_up(rows: DataFrame, segment_rows: int, segment_chars: int) -> DataFrame:
    """Long conversations: equal rows are counted first, segments follow running sums of rows and characters."""
    # The same for all rows of a key, whose conv_id is one value.
    names = rows.groupBy("key").agg(F.max("conv_id").alias("conv_id"))
    known = rows.groupBy("key", *_ORDER).agg(F.sum("copies").alias("copies"))
    # A row that is longer than a segment has one for itself.
    placed = running(known, [F.col(c) for c in ("key", *_ORDER)], {"before": F.lit(1), "chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    same = F.md5(F.concat_ws("\0", "key", "role", "text").cast("binary"))
    placed = cut(placed.withColumns({"segment": F.floor(F.col("before") / segment_rows) + F.floor(F.col("chars") / segment_chars), "same": same, "at": F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn"))}))
    firsts = placed.groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = cut(meet(placed, cut(firsts), "same", "n", how="left").withColumn("seen", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("same", "at", "first", "n", "before", "chars").withColumn("conv_id", F.lit(None).cast("string")))
    chained = cut(_chained(_parsed(marked)))
    hashes = _hashed(marked, chained.filter("segment IS NOT NULL").select("key", "segment", "entry", "audit"))
    return chained.filter("segment IS NULL").drop("segment", "entry").join(hashes, "key").join(names, "key").select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def repaired(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged and repaired."""
    rows = damaged(conversations)
    sizes = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.length("text")).alias("chars"))
    with passing() as stay:
        long = cut(sizes.filter((F.col("n") > segment_rows) | (F.col("chars") > segment_chars)).select("key"))
        if long.isEmpty():
            return _whole(rows)
        stay.append(long)
        out = cut(_cut_up(rows_with(rows, "key", long), segment_rows, segment_chars))
        stay.append(out)
    return _whole(rows_without(rows, "key", long)).unionByName(out)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _plus(value: str, cost: str, edit: str) -> str:
    """SQL of a value 'cost:audit' after one more edit; least() of such values is their minimum, null is out of reach."""
    return f"lpad((substr({value}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || ':' || substr({value}, 11) || '{edit}'"


_OPEN = "least(p.v0, p.vs, p.va)"
OP11_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
names AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc(name, p, c) AS (SELECT name, 1, 4294967295::BIGINT FROM names UNION ALL SELECT name, p + 1, xor(t[(xor(c, ascii(name[p])) & 255) + 1], c >> 8) FROM crc, crcs WHERE p <= length(name)),
fates AS (SELECT name, xor(c, 4294967295) % 20 AS fate FROM crc WHERE p = length(name) + 1),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, fate
         FROM raw JOIN fates USING (name) WHERE fate <> 0),
twice AS (SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE fate = 3),
d AS (SELECT *, coalesce(conv_id::VARCHAR, '-') AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM twice),
f AS (SELECT *, role[1] AS r, lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS two, NOT blank AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS dup FROM d),
e AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cropped FROM f),
rows AS (SELECT *, blank OR dup AS gone, CASE WHEN cropped THEN {TRUNCATED} ELSE 0 END AS t FROM e),
walk(g, i, v0, vs, vu, va) AS (
  SELECT DISTINCT g, 0::BIGINT, '000000000:', NULL::VARCHAR, {_plus("'000000000:'", str(INSERT), "I")}, {_plus("'000000000:'", str(2 * INSERT), "II")} FROM rows
  UNION ALL
  SELECT g, i, v0, vs, u, least(a, {_plus("u", str(INSERT), "I")}) FROM (
    SELECT g, i, v0, vs, least(u, {_plus("least(v0, vs, a)", str(INSERT), "I")}) AS u, a FROM (
      SELECT p.g, q.i, {_plus("p.v0", str(DELETE), "D")} AS v0,
             least({_plus("p.vs", str(DELETE), "D")}, CASE WHEN NOT gone AND r = 's' THEN {_plus("p.v0", "t", "K")} END) AS vs,
             least({_plus("p.vu", str(DELETE), "D")}, CASE WHEN NOT gone AND r = 'u' THEN {_plus(_OPEN, "t", "K")} END, CASE WHEN NOT gone THEN {_plus(_OPEN, f"t + {REROLE}", "R")} END) AS u,
             least({_plus("p.va", str(DELETE), "D")}, CASE WHEN NOT gone AND r = 'a' THEN {_plus("p.vu", "t", "K")} END, CASE WHEN NOT gone THEN {_plus("p.vu", f"t + {REROLE}", "R")} END) AS a
      FROM walk p JOIN rows q ON q.g = p.g AND q.i = p.i + 1))),
best AS (SELECT g, least(v0, va) AS v FROM walk JOIN (SELECT g, max(i) AS i FROM rows GROUP BY g) USING (g, i)),
audits AS (SELECT g, substr(v, 1, 9)::BIGINT AS cost, substr(v, 11) AS audit FROM best),
letters AS (SELECT g, k, audit[k] AS edit, k - length(replace(audit[:k], 'I', '')) AS inserted FROM audits, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)),
shown AS (SELECT l.g, k, edit, r, CASE WHEN edit = 'K' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY l.g ORDER BY k) AS o
          FROM letters l LEFT JOIN rows q ON q.g = l.g AND q.i = k - inserted AND edit <> 'I' WHERE edit <> 'D'),
headed AS (SELECT *, coalesce(bool_or(o = 1 AND edit = 'K' AND r = 's') OVER (PARTITION BY g), false)::INT AS s FROM shown),
final AS (SELECT g, sha256(string_agg(coalesce(role, CASE WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY o)) AS sha FROM headed GROUP BY g),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cropped) AS truncated,
                  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS g FROM conversations) c LEFT JOIN counts USING (g) LEFT JOIN audits USING (g) LEFT JOIN final USING (g)
"""
