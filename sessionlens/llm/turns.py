"""Repair of conversations whose turns were lost, emptied, cut, repeated or given the wrong role.

Rows are laid out by a range exchange over conversation and turn, so a task sees whole conversations in order. Which
turns stay is a shortest path over the turns that are kept or reroled: prefix sums of deletion costs price the gap
between two of them, a running minimum for each role finds the best next one in one step, and the pair of roles says
how many empty turns go between. Of equal costs the audit that is least wins: the longer gap, then the inserted turn,
then the kept one.

A conversation that a task sees only in part, or that is longer than a bounded piece, leaves the task as pieces: the
least cost, and the least audit of that cost, from each role before the piece to each role after it. Costs after each
piece are then folded from the back over rows of a few numbers, every piece decides for itself what each role
before it leads to, and one stream over the pieces in order puts the audit and the hash together, as a hash of a whole
is a stream; it holds no texts but those of one piece.

Defined results: in rows and in the text that the damage is drawn from a null reads as one blank; turns of one number
go by role and text, nulls first; equal rows are counted before they are dealt out, the first is the original; a
conversation without an id is one conversation; an empty role is none of system, user and assistant, like any other
word that begins with another letter, so its turn is reroled or deleted; a conversation that loses all its rows gives
zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import stored, table

RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS, STOPS = " \t\n\v\f\r", ".!?"
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""
#: Roles after which a turn may stand: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
LETTERS, NAMES = " sua", ("", "system", "user", "assistant")
#: Empty turns between a role and the next kept one; no system turn but at the start. At the end, what completes it.
BETWEEN = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
AT_END = (0, 2, 1, 0)
#: Rows and characters of a piece, after which a conversation goes on in another.
PIECE_ROWS, PIECE_CHARS = 4096, 4 << 20
FAR = 1 << 60
#: Characters of a text that turns of one number and role are ranged by.
HEAD = 64


class Turn:
    """A row and its copies: the first has a fault of its own, the copies are deleted."""

    __slots__ = ("copies", "fault", "gone", "letter", "role", "text")

    def __init__(self, role: str, text: str, repeated: bool, copies: int) -> None:
        self.role, self.text, self.copies = role, text, copies
        self.letter = role[:1]
        seen = text.rstrip(BLANKS)
        self.fault = BLANK if not seen else DUPLICATE if repeated else CUT if seen[-1] not in STOPS else SOUND
        self.gone = self.fault in (BLANK, DUPLICATE)


class Paths:
    """Cheapest edits of turns for an end that costs `tail` by the last role; see the module's text."""

    def __init__(self, turns: list[Turn], tail: list[int]) -> None:
        n = len(turns)
        #: what deleting the turns before each one costs
        gone = [0]
        for t in turns:
            gone.append(gone[-1] + DELETE * t.copies)
        self.turns, self.tail = turns, tail
        self.next: list[list[tuple | None]] = [[None] * 4 for _ in range(n)]
        #: for each role the least cost of a next kept turn of it, with the deletions before it, and where it is
        best: list[tuple[int, int, int]] = [(FAR, 0, 0)] * 4

        def after(role: int, at: int) -> tuple[int, tuple]:
            """Least cost from turn `at` on, after a turn of `role`, and (place, role, empty turns) of the next one."""
            found = (gone[n] - gone[at] + tail[role], -n, 0, 0, 0)
            for to in (SYSTEM, USER, ASSISTANT):
                cost, place, reroled = best[to]
                m = BETWEEN.get((role, to))
                if m is not None and cost < FAR:
                    found = min(found, (cost - gone[at] + INSERT * m, -place, -m, reroled, to))
            return min(found[0], FAR), (-found[1], found[4], -found[2])

        for j in range(n - 1, -1, -1):
            t = turns[j]
            if t.gone:
                continue
            rest = DELETE * (t.copies - 1) + (TRUNCATED if t.fault == CUT else 0)
            made = []
            for to in (SYSTEM, USER, ASSISTANT):
                kept = t.letter == LETTERS[to]
                if not kept and to == SYSTEM:
                    continue
                cost, self.next[j][to] = after(to, j + 1)
                if cost < FAR:
                    made.append((to, gone[j] + cost + rest + (0 if kept else RE_ROLE), int(not kept)))
            for to, cost, reroled in made:
                if cost < best[to][0]:
                    best[to] = (cost, j, reroled)
        self.start = [after(role, 0) for role in range(4)]

    def cost(self, role: int) -> int:
        return self.start[role][0]

    def walk(self, role: int) -> Iterator[tuple[str, int, int]]:
        """(edit, place of its turn or -1, role after it) in order, for `role` before the first."""
        turns, n, at = self.turns, len(self.turns), 0
        _, (place, to, m) = self.start[role]
        while True:
            for j in range(at, place):
                for _ in range(turns[j].copies):
                    yield "D", j, role
            for _ in range(m if place < n else AT_END[role] if self.tail[role] else 0):
                role = ASSISTANT if role == USER else USER
                yield "I", -1, role
            if place >= n:
                return
            t, role = turns[place], to
            yield ("K" if t.letter == LETTERS[to] else "R"), place, role
            for _ in range(t.copies - 1):
                yield "D", place, role
            at, (place, to, m) = place + 1, self.next[place][to]


#: What the end costs: a conversation's, and those that let only one role be the last.
WHOLE = [INSERT * m for m in AT_END]


def _only(role: int) -> list[int]:
    return [0 if r == role else FAR for r in range(4)]


def audit(edits: list[tuple[str, int, int]]) -> str:
    return "".join(e for e, _, _ in edits)


def lines(turns: list[Turn], edits: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn after the repair."""
    for edit, j, role in edits:
        if edit == "K":
            yield edit, turns[j].role, turns[j].text
        elif edit in "RI":
            yield edit, NAMES[role], turns[j].text if edit == "R" else ""


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that are left: a fifth is dropped, emptied, stripped of
    its stops, repeated or given the role of the user, as crc32 of `conv_id:turn` says."""
    kind = F.crc32(F.concat(_blank("conv_id"), F.lit(":"), _blank("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(_blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(_blank("text"), "[.!?]", "")).otherwise(_blank("text"))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) by conversation and turn, equal ones in one, with `repeated`: an
    earlier turn of the conversation has role and text too."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("same", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = one.groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    met = one.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    met = met.select("conv_id", "turn", "role", "text", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated"))
    by = ["conv_id", "turn", "role"]
    return met.repartitionByRange(*by, F.substring("text", 1, HEAD)).sortWithinPartitions(*by, "text")


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _schema(kind: str) -> str:
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return (
        f"conv_id {kind}, piece bigint, whole boolean, low bigint, high bigint, turns bigint, first string, last string, {counts}, cost bigint, audit string, "
        "repaired_sha256 string, costs array<bigint>, audits array<string>, role array<string>, text array<string>, repeated array<boolean>, copies array<bigint>"
    )


class _Piece:
    """Rows of one conversation that follow one another, as a task gathers them."""

    def __init__(self, conv_id, number: int) -> None:
        self.conv_id, self.number = conv_id, number
        self.turns: list[Turn] = []
        self.repeats: list[bool] = []
        self.seen: list[int] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool, copies: int) -> None:
        self.turns.append(Turn(role, text, repeated, copies))
        self.repeats.append(repeated)
        if turn is not None and (not self.seen or self.seen[-1] != turn):
            self.seen.append(turn)
        self.chars += len(text) + len(role) + 64

    def full(self, rows: int, chars: int) -> bool:
        return len(self.turns) >= rows or self.chars >= chars

    def row(self, whole: bool) -> dict:
        turns = self.turns
        fault = dict.fromkeys(_COUNTS, 0)
        before = None
        for t in turns:
            if t.fault:
                fault[t.fault] += 1
            if t.copies > 1:
                fault[BLANK if t.fault == BLANK else DUPLICATE] += t.copies - 1
                fault["illegal"] += t.copies - 1  # two of one letter
            if before is not None:
                fault["illegal"] += before + t.letter not in ("su", "ua", "au")
            before = t.letter
        out = {"conv_id": self.conv_id, "piece": self.number, "whole": whole, "low": self.seen[0] if self.seen else None, "high": self.seen[-1] if self.seen else None, "turns": len(self.seen), "first": turns[0].letter, "last": turns[-1].letter} | fault
        if whole:
            paths = Paths(turns, WHOLE)
            edits = list(paths.walk(NONE))
            text = "\n".join(f"{role}:{text}" for _, role, text in lines(turns, edits))
            return out | {"cost": paths.cost(NONE), "audit": audit(edits), "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        costs, audits = [], []
        for last in range(4):
            paths = Paths(turns, _only(last))
            costs += [paths.cost(role) for role in range(4)]
            audits += [audit(list(paths.walk(role))) if paths.cost(role) < FAR else None for role in range(4)]
        return out | {"costs": costs, "audits": audits, "role": [t.role for t in turns], "text": [t.text for t in turns], "repeated": self.repeats, "copies": [t.copies for t in turns]}


def pieces(rows: DataFrame, keep: bool = False) -> DataFrame:
    """A row for each conversation that a task sees whole (all of it done), and for each piece of the others.

    The first and the last conversation of a task may go on in its neighbours, so they are pieces. keep: all are.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _schema(kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, most = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema), (PIECE_ROWS, PIECE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        now: _Piece | None = None
        first, part, out, held = True, False, [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal out, held
            made, out, held = pa.RecordBatch.from_pylist(out, schema=arrow), [], 0
            return made

        for b in batches:
            for conv, turn, role, text, copies, repeated in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "repeated")), strict=True):
                if now is not None and (now.conv_id != conv or now.full(*most)):
                    more = now.conv_id == conv
                    whole = not (first or part or more or keep)
                    out.append(now.row(whole))
                    held += 0 if whole else 2 * now.chars
                    first, part = first and more, more
                    number, now = number + 1, None
                    if len(out) >= 1024 or held > most[1]:
                        yield flushed()
                if now is None:
                    now = _Piece(conv, number)
                now.add(turn, role, text, repeated, copies)
        if now is not None:
            out.append(now.row(False))
        if out:
            yield flushed()

    return stored(rows.select("conv_id", "turn", "role", "text", "copies", "repeated").mapInArrow(run, schema), "turns-pieces")


def _tails(parts: DataFrame) -> DataFrame:
    """piece, tail: what the rows after each piece cost at least, by the last role of the piece. Folded from the
    back of a conversation over sixteen numbers a piece of thousands of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, tail, begun = None, WHOLE, False
        for b in batches:
            number, tails = [], []
            for c, piece, costs in zip(*(b.column(n).to_pylist() for n in ("conv_id", "piece", "costs")), strict=True):
                if not begun or c != conv:
                    conv, tail, begun = c, WHOLE, True
                number.append(piece)
                tails.append(tail)
                tail = [min(FAR, *(costs[4 * last + role] + tail[last] for last in range(4))) for role in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(tails, pa.list_(pa.int64()))], names=["piece", "tail"])

    narrow = parts.select("conv_id", "piece", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    return narrow.mapInArrow(run, "piece bigint, tail array<bigint>")


def _edits(turns: list[Turn], costs: list[int], audits: list[str | None], tail: list[int], role: int) -> tuple[int, list[tuple[str, int, int]], int]:
    """Cost with what follows, edits and last role of a piece, after a turn of `role`: of equal costs the least audit."""
    cost, _, last = min((costs[4 * r + role] + tail[r], audits[4 * r + role], r) for r in range(4) if costs[4 * r + role] < FAR and tail[r] < FAR)
    return cost, list(Paths(turns, _only(last)).walk(role)), last


def _in_order(parts: DataFrame, schema: str, make) -> DataFrame:
    """make(piece row, its turns, its edits with those at the end of a conversation, cost from it on, is first, is last)
    over the pieces of each conversation in order; what it gives are rows of `schema`."""
    rows = parts.join(_tails(parts), "piece").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parts.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, role = None, NONE

        def done(row: dict, is_first: bool, is_last: bool) -> list[dict]:
            nonlocal role
            role = NONE if is_first else role
            turns = [Turn(*x) for x in zip(row["role"], row["text"], row["repeated"], row["copies"], strict=True)]
            cost, edits, role = _edits(turns, row["costs"], row["audits"], row["tail"], role)
            if is_last:
                for _ in range(AT_END[role]):
                    role = ASSISTANT if role == USER else USER
                    edits.append(("I", -1, role))
            return make(row, turns, edits, cost, is_first, is_last)

        is_first = True
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if waiting is not None:
                    is_last = waiting["conv_id"] != row["conv_id"]
                    if made := done(waiting, is_first, is_last):
                        yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    is_first = is_last
                waiting = row
        if waiting is not None and (made := done(waiting, is_first, True)):
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.mapInArrow(run, schema)


_RESULT = [*_COUNTS[:3], "illegal", "cost", "audit", "repaired_sha256"]


def _joined_pieces(parts: DataFrame) -> DataFrame:
    """conv_id, gaps and the rest of a conversation's result from its pieces."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    state: dict = {}

    def make(row: dict, turns: list[Turn], edits: list, cost: int, is_first: bool, is_last: bool) -> list[dict]:
        if is_first:
            state.clear()
            state.update(sha=hashlib.sha256(), lines=0, audit=[], turns=0, low=None, high=None, last=None, cost=cost, counts=dict.fromkeys(_COUNTS, 0))
        counts = state["counts"]
        for c in _COUNTS:
            counts[c] += row[c]
        if state["last"] is not None:
            counts["illegal"] += state["last"] + row["first"] not in ("su", "ua", "au")
        if row["low"] is not None:
            state["turns"] += row["turns"] - (row["low"] == state["high"])
            state["low"] = row["low"] if state["low"] is None else state["low"]
            state["high"] = row["high"]
        state["last"] = row["last"]
        state["audit"].append(audit(edits))
        for _, role, text in lines(turns, edits):
            state["sha"].update((("\n" if state["lines"] else "") + f"{role}:{text}").encode())
            state["lines"] += 1
        if not is_last:
            return []
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
        return [{"conv_id": row["conv_id"], "gaps": gaps, "cost": state["cost"], "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()} | counts]

    schema = f"conv_id {kind}, gaps bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", cost bigint, audit string, repaired_sha256 string"
    return _in_order(parts, schema, make)


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and hash of each conversation of rows (conv_id, turn, role,
    text, copies)."""
    made = pieces(ordered(rows))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = made.where("whole").select("conv_id", gaps, *_RESULT)
    return whole.unionByName(_joined_pieces(made.where("not whole")).select("conv_id", "gaps", *_RESULT))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, piece, place, edit, role, text: the turns after the repair, in order of (piece, place)."""
    parts = pieces(ordered(rows), keep=True)
    kind = parts.schema["conv_id"].dataType.simpleString()

    def make(row: dict, turns: list[Turn], edits: list, cost: int, is_first: bool, is_last: bool) -> list[dict]:
        return [{"conv_id": row["conv_id"], "piece": row["piece"], "place": k, "edit": e, "role": r, "text": t} for k, (e, r, t) in enumerate(lines(turns, edits))]

    return _in_order(parts, f"conv_id {kind}, piece bigint, place int, edit string, role string, text string", make)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    all_ids = convs.select(F.col("conv_id").alias("id")).distinct()
    out = all_ids.join(repairs(damaged(convs)), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle_sql() -> str:
    bit = "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    key = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
    codes = f"list_transform(string_split({key}, ''), lambda x: ascii(x)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), {byte}), 4294967295::UBIGINT)"
    between = ", ".join(f"({q}, {to}, {m}, '{'I' * m}', '{(NAMES[USER if to == ASSISTANT else ASSISTANT] + ':') if m else ''}')" for (q, to), m in BETWEEN.items())
    ends = ", ".join(f"({q}, {m}, '{'I' * m}', '{chr(44).join((['user:', 'assistant:'] if q == SYSTEM else ['assistant:'])[:m])}')" for q, m in enumerate(AT_END))
    roles = ", ".join(f"({r}, '{LETTERS[r]}', '{NAMES[r]}')" for r in (SYSTEM, USER, ASSISTANT))
    return rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, (VALUES (0), (1)) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (place > 1 AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
between_(q, dest, m, ins, line) AS (VALUES {between}),
ends(q, m, ins, lines) AS (VALUES {ends}),
roles(r, letter, name) AS (VALUES {roles}),
moves AS (
  SELECT conv_id, place, q, q AS dest, {DELETE} AS price, 'D' AS edit, CAST([] AS VARCHAR[]) AS made
  FROM judged, (VALUES (0), (1), (2), (3)) AS states(q)
  UNION ALL
  SELECT conv_id, place, q, dest, m * {INSERT} + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END + CASE WHEN substr(role, 1, 1) = letter THEN 0 ELSE {RE_ROLE} END,
         ins || CASE WHEN substr(role, 1, 1) = letter THEN 'K' ELSE 'R' END,
         CASE WHEN m > 0 THEN [line] ELSE [] END || [CASE WHEN substr(role, 1, 1) = letter THEN role ELSE name END || ':' || text]
  FROM judged, between_ JOIN roles ON dest = r
  WHERE fault NOT IN ('blank', 'duplicate') AND (substr(role, 1, 1) = letter OR r > 1)),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'made': CAST([] AS VARCHAR[])}} AS best FROM counted
  UNION ALL
  SELECT p.conv_id, p.place + 1, s.dest, min({{'cost': p.best.cost + s.price, 'audit': p.best.audit || s.edit, 'made': p.best.made || s.made}})
  FROM paths p JOIN moves s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND s.place = p.place + 1 AND s.q = p.q
  GROUP BY ALL),
ended AS (
  SELECT p.conv_id, min({{'cost': best.cost + e.m * {INSERT}, 'audit': best.audit || e.ins, 'made': best.made || CASE WHEN e.m > 0 THEN string_split(e.lines, ',') ELSE [] END}}) AS best
  FROM paths p JOIN counted c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.place = c.n JOIN ends e USING (q) GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _oracle_sql()
