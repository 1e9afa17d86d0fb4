"""Conversation structure repair: iterative-deepening A* over the edits of a conversation.

A conversation should read ``(s?(ua)+)?`` in role initials and hold no blank, repeated or cut-off row.
The search goes through its rows depth first, tries edits in ASCII order of their initials (Delete,
Insert, Keep, Rerole) and drops a path once its cost and a lower bound of what is left exceed the cost
bound. The bound grows to the least cost that was dropped. A table holds, for every (row, state), the
largest budget that has failed; it stays valid under every later bound, so a state is searched at most
once a budget. The first path that ends well is the cheapest, and the ASCII-least of the cheapest.

* Rows are dealt and sorted by ranges of (conversation, turn), so one long conversation is spread over
  tasks. A task repairs alone what lies whole inside its range, which is nearly all.
* What touches the ends of a range, or has more rows than a piece, is cut into pieces. A piece is searched
  from every state to every state. No path is the beginning of another that consumes the same rows, so the
  least paths of pieces make up the least path of all: one pass backwards over the pieces' costs gives what
  the rest will cost, one pass forwards takes the path. Both passes hold one conversation's state only.
* The digest of a conversation is one SHA-256 over all its text, so the forward pass of one conversation is
  one stream; only its hashing is serial, the search is not.
* Repeated rows are found by digests of (role, text), in a combined aggregate; only rows that do stand
  twice are grouped by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored
from .words import give_back

#: A piece holds at most so many rows, and so many characters unless one row alone has more.
PIECE_ROWS, PIECE_CHARS = 256, 1 << 16
INSERT, DELETE, REROLE, CUT = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What may be kept, and what else comes next.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_ROLE = ("", "", "user", "assistant")
#: Edits that end a conversation from each state.
_END = ("", "II", "I", "")
_LEGAL = ("su", "ua", "au")


def _least(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """A lower bound of the cost of every suffix.

    Rows to delete and rows cut off cost what they must; of the pairs of rows that may not stand side by
    side, each that shares no row with another needs an edit of its own.
    """
    n = len(rows)
    out, pairs, nearest = [0] * (n + 1), [0] * (n + 1), n
    after = n  # the live row after the nearest one
    following = [n] * (n + 1)
    forced = 0
    for i in range(n - 1, -1, -1):
        initial, gone, cut = rows[i]
        pairs[i] = pairs[i + 1]
        if gone:
            forced += DELETE
        else:
            forced += CUT * cut
            if nearest < n and initial + rows[nearest][0] not in _LEGAL:
                weight = DELETE - CUT if cut or rows[nearest][2] else INSERT
                pairs[i] = max(pairs[i], weight + pairs[following[nearest]])
            after, nearest = nearest, i
            following[i] = after
        out[i] = forced + pairs[i]
    return out


def cheapest(rows: list[tuple[str, bool, bool]], entry: int = 0, leave: int | None = None,
             least: list[int] | None = None) -> tuple[int, str] | None:
    """Cost and edits of the cheapest path, the ASCII-least of them; rows are (initial, must go, cut off).

    With ``leave`` the path must be in that state right after the last row (None if it cannot be);
    without, it must end a conversation.
    """
    n = len(rows)
    least = least or _least(rows)
    early = leave is not None and leave < 2
    if early and entry > leave:
        return None
    failed = [-1] * (4 * n + 4)
    limit = (DELETE + CUT) * n + INSERT * (n + 4)  # dearer than any sensible path
    bound = max(least[0], DELETE * (n - 1)) if early else least[0]
    while bound <= limit:
        beyond = limit + 1
        path: list[str] = []
        stack = [[0, entry, bound, 0]]
        while stack:
            frame = stack[-1]
            i, state, budget, move = frame
            if move == 0 and i == n and (state == leave if leave is not None else state in (0, 3)):
                return bound - budget, "".join(path)
            step = None
            while move < 4 and step is None:
                if move == 0:
                    if i < n:
                        step = ("D", i + 1, state, DELETE)
                elif move == 1:
                    if i < n or leave is None:
                        step = ("I", i, _NEXT[state], INSERT)
                elif i < n and not rows[i][1]:
                    if move == 2:
                        to = _KEEP[state].get(rows[i][0])
                        if to is not None:
                            step = ("K", i + 1, to, CUT * rows[i][2])
                    else:
                        step = ("R", i + 1, _NEXT[state], REROLE + CUT * rows[i][2])
                move += 1
                if step is not None:
                    _, j, to, cost = step
                    left = budget - cost
                    need = max(least[j], failed[4 * j + to] + 1)
                    if early:  # no way back to these states: the rest is deleted, but for one row to get there
                        need = limit + 1 if to > leave else max(need, DELETE * (n - j - (to < leave)))
                    if left < need:
                        beyond = min(beyond, bound + need - left)  # beyond the limit there is no way
                        step = None
            frame[3] = move
            if step is None:
                failed[4 * i + state] = max(failed[4 * i + state], budget)
                stack.pop()
                if path:
                    path.pop()
            else:
                path.append(step[0])
                stack.append([step[1], step[2], left, 0])
        bound = beyond
    return None


def repaired(rows: list[tuple[str, str]], edits: str, state: int = 0) -> tuple[list[str], int]:
    """The lines ``role:text`` that the edits leave of (role, text) rows, and the state after them."""
    out, at = [], 0
    for e in edits:
        if e == "I":
            state = _NEXT[state]
            out.append(f"{_ROLE[state]}:")
            continue
        role, text = rows[at]
        at += 1
        if e == "K":
            state = _KEEP[state][role[:1]]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = _NEXT[state]
            out.append(f"{_ROLE[state]}:{text}")
    return out, state


class _Piece:
    """Rows of one conversation in order, and what is counted over them."""

    def __init__(self):
        self.rows, self.texts, self.chars = [], [], 0
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.initials = [None, None]
        self.lo = self.hi = None

    def add(self, turn, role, text, fresh):
        """Append one row; turns come in order."""
        body = text.strip(SPACES)
        fault = 0 if not body else 1 if not fresh else 2 if body[-1] not in ".!?" else None
        if fault is not None:
            self.faults[fault] += 1
        initial = role[:1]
        if self.rows:
            self.illegal += self.initials[1] + initial not in _LEGAL
        else:
            self.initials[0] = initial
        self.initials[1] = initial
        if turn is not None:
            self.turns += turn != self.hi
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        self.rows.append((initial, fault in (0, 1), fault == 2))
        self.texts.append((role, text))
        self.chars += len(text) + len(role)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "lo", "hi"]
_PIECES = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int32()), ("whole", pa.bool_())] + [(c, pa.int64()) for c in _COUNTS]
    + [("initials", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
       ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
       ("texts", pa.list_(pa.string())), ("part", pa.int32())])
_PIECES_DDL = ("conv long, piece int, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS)
               + ", initials array<string>, cost long, audit string, sha string, costs array<int>, "
               "audits array<string>, roles array<string>, texts array<string>, part int")


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _searched(conv, number: int, part: int, p: _Piece, whole: bool) -> dict:
    row = {"conv": conv, "piece": number, "part": part, "whole": whole,
           **dict(zip(_COUNTS, [*p.faults, p.illegal, p.turns, p.lo, p.hi]))}
    if whole:
        row["cost"], row["audit"] = cheapest(p.rows)
        row["sha"] = _digest(repaired(p.texts, row["audit"])[0])
        return row
    least, found = _least(p.rows), []
    for entry in range(4):
        found += [cheapest(p.rows, entry, leave, least) for leave in range(4)]
    return row | {"initials": p.initials, "costs": [x and x[0] for x in found], "audits": [x and x[1] for x in found],
                  "roles": [r for r, _ in p.texts], "texts": [t for _, t in p.texts]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if len(out) == 1000 or chars > 4 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired, others as pieces; the batches are one sorted range."""
    part = TaskContext.get().partitionId()

    def pieces():
        number, held = 0, None  # the first and last conversation of a range may go on beyond it
        for at, (conv, rows) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            if held:
                yield _searched(*held[:2], part, held[2], at > 1 and held[3] == 1)
            p, count = _Piece(), 1
            for _, turn, role, text, copies, fresh in rows:
                for c in range(copies):
                    if p.full():
                        yield _searched(conv, number, part, p, False)
                        number, count, p = number + 1, count + 1, _Piece()
                    p.add(turn, role, text, fresh and c == 0)
            held = (conv, number, p, count)
            number += 1
        if held:
            yield _searched(*held[:2], part, held[2], False)

    yield from _batches(pieces(), _PIECES)
    give_back()


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rest costs after each piece, by state; pieces come last first."""

    def rests():
        for _, pieces in groupby(_rows(batches), key=lambda r: r[0]):
            rest = [INSERT * len(e) for e in _END]
            for conv, part, piece, costs in pieces:
                yield {"part_": part, "piece_": piece, "rest": rest}
                rest = [min((c + r for c, r in zip(costs[4 * s:4 * s + 4], rest) if c is not None and r is not None),
                            default=None) for s in range(4)]

    yield from _batches(rests(), pa.schema([("part_", pa.int32()), ("piece_", pa.int32()),
                                            ("rest", pa.list_(pa.int64()))]))


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's path and digest; pieces come in order, with what the rest costs after them."""

    def one(conv, pieces):
        total, audit, sha, state, started, cost = dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), 0, False, 0
        lo = hi = last = None

        def write(lines):
            nonlocal started
            for line in lines:
                sha.update((("\n" if started else "") + line).encode("utf-8", "surrogatepass"))
                started = True

        for x in pieces:
            for c in _COUNTS[:5]:
                total[c] += x[c]
            if last is not None and x["initials"][0] is not None:
                total["illegal"] += last + x["initials"][0] not in _LEGAL
            last = x["initials"][1] if x["initials"][1] is not None else last
            if x["lo"] is not None:
                total["turns"] -= x["lo"] == hi
                lo, hi = x["lo"] if lo is None else lo, x["hi"]
            ways = [(x["costs"][4 * state + o] + x["rest"][o], x["audits"][4 * state + o], o) for o in range(4)
                    if x["costs"][4 * state + o] is not None and x["rest"][o] is not None]
            _, edits, to = min(ways)
            cost += x["costs"][4 * state + to]
            lines, state = repaired(list(zip(x["roles"], x["texts"])), edits, state)
            audit.append(edits)
            write(lines)
        audit.append(_END[state])
        write(repaired([], _END[state], state)[0])
        return total | {"conv": conv, "whole": True, "cost": cost + INSERT * len(_END[state]), "lo": lo, "hi": hi,
                        "audit": "".join(audit), "sha": sha.hexdigest()}

    def named():
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1).to_pylist()[0]

    yield from _batches((one(conv, pieces) for conv, pieces in groupby(named(), key=lambda x: x["conv"])), _PIECES)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of the query: ``(conv, turn, role, text, copies)`` damaged by the CRC of ``conv_id:turn``.

    A dropped row stays with no copies, so that its conversation is known; null roles and texts are one space.
    """
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv, turn, role, text, copies)``: its faults, cost, edits and digest.

    Rows go by turn (null turns first), then by role and text; rows that are equal in all of these are
    repeats of one another. A null ``conv`` is one conversation. A role's initial is its first character; an
    empty role has none and is never legal. A text of white space is blank. A conversation without copies
    has zeros, no edits and the digest of the empty string. Very long texts are whole in one row; nothing
    longer than one text is built. Other columns are ignored; an empty table gives no rows.
    """
    live = rows.where("copies > 0").select("conv", "turn", "role", "text", "copies", F.md5("text").alias("d"))
    twice = (live.groupBy("conv", "role", "d").agg(F.min(F.struct("turn")).alias("first"), F.sum("copies").alias("n"))
             .where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("d").alias("e"), "first"))
    known = live.join(twice, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                      & (F.col("d") == F.col("e")), "left")
    columns = ["conv", "turn", "role", "text", "copies", "fresh"]
    alone = known.where("first is null").withColumn("fresh", F.lit(True))
    again = (known.where("first is not null").groupBy("conv", "turn", "role", "text", "first")
             .agg(F.sum("copies").cast("int").alias("copies"))
             .withColumn("fresh", F.col("turn").eqNullSafe(F.col("first.turn"))))
    none = rows.where("copies = 0").select("conv").distinct().select(
        "conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).alias("copies"), F.lit(False).alias("fresh"))
    order = ["conv", "turn", "role", "text"]
    table = alone.select(*columns).unionByName(again.select(*columns)).unionByName(none)
    found = stored(table.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_search, _PIECES_DDL), "repair")
    open_ = found.where("not whole")
    rest = (open_.select("conv", "part", "piece", "costs").repartition("conv")
            .sortWithinPartitions(F.col("conv"), F.col("part").desc(), F.col("piece").desc())
            .mapInArrow(_backwards, "part_ int, piece_ int, rest array<long>"))
    composed = (open_.join(rest, (F.col("part") == F.col("part_")) & (F.col("piece") == F.col("piece_")))
                .repartition("conv").sortWithinPartitions("conv", "part", "piece")
                .mapInArrow(_forwards, _PIECES_DDL))
    return found.where("whole").unionByName(composed).select(
        F.col("conv").alias("conv_id"), F.coalesce(F.expr("hi - lo + 1 - turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repair_sql() -> str:
    """The damage, the faults and a dynamic program over the rows in DuckDB SQL, on whole tables."""
    crc = ("list_reduce(list_prepend(4294967295::bigint, list_transform(split(k, ''), lambda x: ascii(x)::bigint)), lambda c, b: "
           "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: "
           "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))")

    def best(*ways):
        return f"list_min([{', '.join(w for w in ways)}])"

    def way(state, cost, edits, line):
        """One more step from a state that may be out of reach (null)."""
        return (f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || {edits}, "
                f"'t': {state}.t || {line}}} end")

    cut = "(case when cut then 3 else 0 end)"
    user, bot = r"chr(10) || 'user:'", r"chr(10) || 'assistant:'"

    def row(state, initial, to):
        """Ways to consume the row from a state: kept if its initial fits, else given the role ``to``."""
        keep = way(state, cut, "'K'", "chr(10) || role || ':' || text").replace(
            "case when ", f"case when not gone and ini = '{initial}' and ", 1)
        return keep, (way(state, f"3 + {cut}", "'R'", f"chr(10) || '{to}:' || text").replace(
            "case when ", "case when not gone and ", 1) if to else "null")

    # n0..n3: the states with the inserts before the row; d: the row deleted from them.
    into2 = [way("s0", 3, "'I'", user), way("s1", 3, "'I'", user), way("s3", 3, "'I'", user)]
    n2 = best("s2", *into2)
    n3 = best("s3", way("s2", 3, "'I'", bot), way("s0", 6, "'II'", f"{user} || {bot}"),
              way("s1", 6, "'II'", f"{user} || {bot}"))
    return rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
f as (select conv_id, turn, r, t, xor({crc}, 4294967295) % 20 f from k),
d as (select conv_id, turn, case when f = 4 then 'user' else r end as role,
        case when f = 1 then '' when f = 2 then translate(t, '.!?', '') else t end as text,
        unnest(range(case when f = 0 then 0 when f = 3 then 2 else 1 end)) copy from f),
o as (select conv_id, turn, role, text, left(role, 1) ini,
        row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 seen,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) last from d),
x as (select *, case when last = '' then 'b' when seen then 'd' when last not in ('.', '!', '?') then 't' else '' end fault,
        lag(ini) over (partition by conv_id order by i) || ini pair from o),
e as (select *, fault in ('b', 'd') gone, fault = 't' cut from x),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps,
        count(*) filter (where fault = 'b') blank, count(*) filter (where fault = 'd') duplicate,
        count(*) filter (where fault = 't') truncated,
        count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) illegal, count(*) size
      from e group by conv_id),
p as (select conv_id, 0::bigint i, {{'c': 0::bigint, 'a': '', 't': ''}} s0, null::struct(c bigint, a varchar, t varchar) s1,
        null::struct(c bigint, a varchar, t varchar) s2, null::struct(c bigint, a varchar, t varchar) s3 from n
      union all
      select q.conv_id, e.i, {way("s0", 4, "'D'", "''")},
        {best(way("s1", 4, "'D'", "''"), row("s0", "s", "")[0])},
        {best(way("n2", 4, "'D'", "''"), *row("s0", "u", "user"), *row("s1", "u", "user"), *row("n3", "u", "user"))},
        {best(way("n3", 4, "'D'", "''"), *row("n2", "a", "assistant"))}
      from (select *, {n2} n2, {n3} n3 from p) q
      join e on e.conv_id is not distinct from q.conv_id and e.i = q.i + 1),
z as (select n.*, {best("s0", "s3", way("s2", 3, "'I'", bot), way("s1", 6, "'II'", f"{user} || {bot}"))} b
      from p join n on n.conv_id is not distinct from p.conv_id and n.size = p.i)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank,
       coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
       coalesce(illegal, 0)::bigint illegal, coalesce(b.c, 0)::bigint cost, coalesce(b.a, '') audit,
       sha256(coalesce(b.t[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join z on z.conv_id is not distinct from c.conv_id
"""
