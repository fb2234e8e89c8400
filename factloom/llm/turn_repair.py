"""Repair of conversations: the cheapest edits that give a turn order (system)? (user assistant)+, or nothing.

A conversation's rows stand by turn (nulls first), rows of one turn by role and then text.  The first fault of a row counts:
blank (nothing but whitespace), duplicate (role and text seen earlier), truncated (ends in none of ``.!?``).  Keeping a row
costs 0, giving it the role user or assistant ``REROLE``, deleting it ``DELETE`` (required for blank and duplicate rows),
inserting a turn without text ``INSERT``, and a truncated row that is not deleted ``TRUNCATED`` more.

The edits are found over retained rows only (kept or reroled).  The rows between two retained ones are deleted, which prefix
sums of deletions price, and the roles of the two decide how many turns are inserted there; so each row asks, for each role
that the retained row before it may have, one running minimum of cost less the deletions before.  In a gap deletions stand
before insertions.  Equal costs are told apart by the audit, the string of the edits' initials, ASCII-least first; two audits
over the same rows that end at a retained row or a deletion are never the one a beginning of the other, so the lesser one
stays the lesser whatever follows.

For the same reason a stretch of rows is a small table: for the role before it and the role at its end, the least cost and
audit.  Rows are dealt by ranges of (conversation, turn, role, beginning of text) and cut into stretches of at most
``STRETCH`` rows; a conversation that lies within one stretch of one part is finished there, and the tables of longer ones
are joined in order (tables only: the texts stay where they are until the edits are known).  No conversation is held whole.
Its audit is one string and its hash one pass over the repaired texts, both in the nature of the result.

Nulls in role and text are one space (a blank row); turns that are null stand first and count for no gap; rows with a null
conversation are one conversation.  Rows equal in all four columns are copies of which all but the first are duplicates.
Very long texts are taken whole.  An empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, join_ids, result, ship, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STRETCH, STRETCH_BYTES = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: what stands before a retained row: nothing, or a retained row of that role
NOTHING, SYSTEM, USER, ASSISTANT = "-", "s", "u", "a"
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: turns to insert between two retained rows, by their roles; pairs that are not here cannot be mended
BETWEEN = {(NOTHING, SYSTEM): 0, (NOTHING, USER): 0, (NOTHING, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
#: turns to insert after the last retained row
AFTER = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}


class Best(NamedTuple):
    cost: int  # less the deletions of all rows before ``at``
    audit: str
    at: int  # rows that the audit covers

    def until(self, row: int) -> str:
        return self.audit + "D" * (row - self.at)


def cheapest(rows: list[tuple[str | None, bool, int]], before: str) -> dict[str, tuple[int, str]]:
    """Role at the end -> (cost, audit) of a stretch after ``before``. rows: (role's initial, or None if it must go; truncated; how many)."""
    run = {before: Best(0, "", 0)}
    place = 0
    for initial, cut, times in rows:
        if initial is not None:
            found: dict[str, tuple[int, str]] = {}
            for role, edit, price in ((initial, "K", 0), (USER, "R", REROLE), (ASSISTANT, "R", REROLE)):
                if edit == "R" and role == initial:
                    continue
                for last, b in run.items():
                    inserts = BETWEEN.get((last, role))
                    if inserts is None:
                        continue
                    cost = b.cost + DELETE * place + INSERT * inserts + price + TRUNCATED * cut
                    if role not in found or cost <= found[role][0]:
                        new = (cost, b.until(place) + "I" * inserts + edit)
                        found[role] = min(new, found.get(role, new))
            for role, (cost, audit) in found.items():
                new, old = Best(cost - DELETE * (place + 1), audit, place + 1), run.get(role)
                if old is None or (new.cost, audit) < (old.cost, old.until(place + 1) if new.cost == old.cost else ""):
                    run[role] = new
        place += times
    return {role: (b.cost + DELETE * place, b.until(place)) for role, b in run.items()}


def edited(audit: str, before: str, rows: Iterator[tuple[str, str] | None]) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits leave; rows: (role, text), or None for one that must go."""
    last = before
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K":
            last = role[:1]
        else:
            last = ASSISTANT if last == USER else USER
            role = NAMES[last]
        yield role, text


def line_of(turns: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


class Stretch:
    """Consecutive rows of one conversation, and what is known of them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str | None, bool, int]] = []
        self.kept: list[tuple[str, str] | None] = []  # beside ``rows``
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.n = self.n_turns = 0
        self.first_role = self.last_role = None
        self.low = self.high = None

    def full(self) -> bool:
        return len(self.rows) >= STRETCH or self.size >= STRETCH_BYTES

    def add(self, turn: int | None, role: str, text: str, times: int, repeated: bool) -> None:
        """``times`` copies of a row; ``repeated``: role and text have been seen before the first of them."""
        if not times:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.n_turns = turn if self.low is None else self.low, turn, self.n_turns + 1
        if self.n and self.last_role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.illegal += times - 1  # a role is no legal neighbour of itself
        self.first_role = role if self.first_role is None else self.first_role
        self.last_role, self.n = role, self.n + times
        plain = text.rstrip(SPACE)
        if not plain:
            self.blank += times
            return self._must_go(times)
        if repeated:
            self.duplicate += times
            return self._must_go(times)
        cut = plain[-1] not in ".!?"
        self.truncated += cut
        self.rows.append((role[:1], cut, 1))
        self.kept.append((role, text))
        self.size += len(text)
        if times > 1:
            self.duplicate += times - 1
            self._must_go(times - 1)

    def _must_go(self, times: int) -> None:
        if self.rows and self.rows[-1][0] is None:
            times += self.rows.pop()[2]
            self.kept.pop()
        self.rows.append((None, False, times))
        self.kept.append(None)

    def turns(self) -> Iterator[tuple[str, str] | None]:
        for (_, _, times), kept in zip(self.rows, self.kept, strict=True):
            for _ in range(times):
                yield kept

    def counts(self) -> tuple[int, ...]:
        return self.n, self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal


def finish(ends: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, from the roles that it may end with."""
    return min((cost + INSERT * AFTER[role], audit + "I" * AFTER[role]) for role, (cost, audit) in ends.items())


_COUNTS = "n long, n_turns long, blank long, duplicate long, truncated long, illegal long"
_ENDS = "first_role string, last_role string, low long, high long"
#: ``steps``: the table of an unfinished stretch; roles, texts: its rows (null: must go), or the repaired ones of a finished conversation
STRETCHES = f"hidden boolean, conv long, part int, nth int, whole boolean, {_COUNTS}, {_ENDS}, cost long, audit string, sha string, steps array<struct<before: string, after: string, cost: long, audit: string>>, times array<long>, roles array<string>, texts array<string>"
_LIST = pa.list_(pa.string())
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_STRETCH_TYPES = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _STEPS, pa.list_(pa.int64()), _LIST, _LIST]


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in _top_level(schema)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _top_level(schema: str) -> list[str]:
    """The columns of a schema string, without splitting inside brackets."""
    depth, out = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a part -> its stretches; conversations that lie wholly inside it are finished."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    held = 0
    key, open_, nth, first = None, Stretch(), 0, True

    def close(whole: bool) -> None:
        nonlocal held
        ends = (open_.first_role, open_.last_role, open_.low, open_.high)
        if whole:
            cost, audit = finish(cheapest(open_.rows, NOTHING))
            left = list(edited(audit, NOTHING, open_.turns()))
            row = (*key, part, nth, True, *open_.counts(), *ends, cost, audit, hashlib.sha256(line_of(iter(left)).encode()).hexdigest(), None, None, [r for r, _ in left], [t for _, t in left])
        else:
            starts = (NOTHING, SYSTEM, USER, ASSISTANT) if first or nth else (NOTHING,)
            steps = [{"before": b, "after": a, "cost": c, "audit": s} for b in starts for a, (c, s) in cheapest(open_.rows, b).items()]
            row = (*key, part, nth, False, *open_.counts(), *ends, None, None, None, steps, [t for _, _, t in open_.rows], [k and k[0] for k in open_.kept], [k and k[1] for k in open_.kept])
        out.append(row)
        held += open_.size

    for b in batches:
        for hidden, conv, turn, role, text, times, repeated in zip(*(b.column(c).to_pylist() for c in ("hidden", "conv", "turn", "role", "text", "times", "repeated")), strict=True):
            if (hidden, conv) != key:
                if key is not None:
                    close(not first and not nth)
                    first = False
                key, open_, nth = (hidden, conv), Stretch(), 0
            elif open_.full():
                close(False)
                open_, nth = Stretch(), nth + 1
            open_.add(turn, role, text, times, repeated)
            if len(out) >= STRETCH or held >= STRETCH_BYTES:
                yield _batch(out, _STRETCH_TYPES, STRETCHES)
                out, held = [], 0
    if key is not None:
        close(False)  # the next part may go on with it
    yield _batch(out, _STRETCH_TYPES, STRETCHES)


#: nth < 0: the conversation; else the edits of one stretch and the role before it
CHOSEN = f"hidden boolean, conv long, part int, nth int, {_COUNTS}, {_ENDS}, cost long, audit string, before string"
_CHOSEN_TYPES = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Sorted rows by conversation."""
    rows = (r for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist())
    return groupby(rows, key=lambda r: (r["hidden"], r["conv"]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each conversation in order -> the edits chosen in each, and the conversation's row."""
    for key, parts in _in_order(batches):
        ends: dict[str, tuple[int, int]] = {NOTHING: (0, 0)}  # role -> (cost, rank of the audit so far)
        path: list[tuple[int, int, dict[str, tuple[str, str]]]] = []
        counts, first_role, last_role, low, high = [0] * 6, None, None, None, None
        for s in parts:
            best: dict[str, tuple[int, int, str, str]] = {}
            for step in s["steps"]:
                if step["before"] in ends:
                    cost, rank = ends[step["before"]]
                    new = (cost + step["cost"], rank, step["audit"], step["before"])
                    best[step["after"]] = min(new, best.get(step["after"], new))
            order = {role: k for k, role in enumerate(sorted(best, key=lambda r: best[r][1:3]))}
            ends = {role: (b[0], order[role]) for role, b in best.items()}
            path.append((s["part"], s["nth"], {role: (b[3], b[2]) for role, b in best.items()}))
            for k, c in enumerate(("n", "n_turns", "blank", "duplicate", "truncated", "illegal")):
                counts[k] += s[c]
            counts[1] -= high is not None and s["low"] == high
            counts[5] += last_role is not None and s["first_role"] is not None and last_role[:1] + s["first_role"][:1] not in LEGAL
            first_role, last_role = s["first_role"] if first_role is None else first_role, last_role if s["last_role"] is None else s["last_role"]
            low, high = s["low"] if low is None else low, high if s["high"] is None else s["high"]
        cost, _, role = min((c + INSERT * AFTER[r], rank, r) for r, (c, rank) in ends.items())
        tail, rows = "I" * AFTER[role], []
        for part, nth, choice in reversed(path):
            before, audit = choice[role]
            rows.append((*key, part, nth, *[None] * 10, None, audit + tail, before))
            role, tail = before, ""
        rows.append((*key, -1, -1, *counts, first_role, last_role, low, high, cost, "".join(r[-2] for r in reversed(rows)), None))
        for a in range(0, len(rows), 256):
            yield _batch(rows[a : a + 256], _CHOSEN_TYPES, CHOSEN)


REPAIRED = "hidden boolean, conv long, part int, nth int, roles array<string>, texts array<string>"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their edits -> what is left of them."""
    for b in batches:
        for k in range(b.num_rows):
            (r,) = b.slice(k, 1).to_pylist()
            rows = (None if role is None else (role, text) for role, text, times in zip(r["roles"], r["texts"], r["times"], strict=True) for _ in range(times))
            left = list(edited(r["audit"], r["before"], rows))
            yield _batch([(r["hidden"], r["conv"], r["part"], r["nth"], [x for x, _ in left], [t for _, t in left])], [*_STRETCH_TYPES[:4], _LIST, _LIST], REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, parts in _in_order(batches):
        sha, some = hashlib.sha256(), False
        for s in parts:
            if s["roles"]:
                sha.update((("\n" if some else "") + line_of(zip(s["roles"], s["texts"], strict=True))).encode())
                some = True
        yield _batch([(*key, sha.hexdigest())], [pa.bool_(), pa.int64(), pa.string()], "hidden boolean, conv long, sha string")


def _marked(turns: DataFrame, tables: Tables) -> DataFrame:
    """hidden, conv, turn, role, text, times, repeated: distinct rows, how often they stand, and whether role and text have been seen earlier."""
    conv = F.col("conv_id").cast("long")
    times = F.col("times").cast("long") if "times" in turns.columns else F.lit(1)
    rows = turns.select(conv.isNull().alias("hidden"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.alias("times"))
    digest = [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2")]
    keys = ["hidden", "conv", "role", "d1", "d2"]
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.filter("times > 0").select("hidden", "conv", "role", *digest, turn.alias("t")).groupBy(*keys).agg(F.min("t").alias("t"), F.max("t").alias("last"))
    again = tables.put(seen.filter("t < last").select(*keys, F.col("t.turn").alias("start")), "repeated")
    rows = rows.groupBy("hidden", "conv", "turn", "role", "text").agg(F.sum("times").alias("times")).select("*", *digest)
    rows = join_ids(rows, again.withColumn("is", F.lit(True)), keys, "left")
    return rows.select("hidden", "conv", "turn", "role", "text", "times", (F.coalesce("is", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("start"))).alias("repeated"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired) of rows conv_id, turn, role, text (and times, if a row stands several times or not at all).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id.
    repaired: conv_id, place (from 0 within its stretch), part, nth, role, text of every turn that is left, in the order of
    (part, nth, place).
    """
    spark = turns.sparkSession
    ship(spark)
    with Tables(spark, "turn-repair") as tables:
        order = ["hidden", "conv", F.col("turn").asc_nulls_first(), "role"]
        dealt = _marked(turns, tables).repartitionByRange(*order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
        stretches = tables.put(dealt.mapInArrow(_stretches, STRETCHES), "stretches")
        keys = ["hidden", "conv", "part", "nth"]
        parts = stretches.filter("not whole")
        chosen = tables.put(parts.drop("whole", "cost", "audit", "sha", "times", "roles", "texts").repartition("hidden", "conv").sortWithinPartitions(*keys).mapInArrow(_joined, CHOSEN), "chosen")
        edits = chosen.filter("nth >= 0").select(*keys, "audit", "before")
        left = tables.put(parts.select(*keys, "times", "roles", "texts").join(edits, keys).mapInArrow(_applied, REPAIRED), "repaired")
        sha = left.repartition("hidden", "conv").sortWithinPartitions(*keys).mapInArrow(_hashed, "hidden boolean, conv long, sha string")
        known = ["hidden", "conv", "n_turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
        both = stretches.filter("whole").select(*known).unionByName(chosen.filter("nth < 0").drop("sha").join(sha, ["hidden", "conv"]).select(*known))
        conv_id = F.when(~F.col("hidden"), F.col("conv")).alias("conv_id")
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
        out = result(both.select(conv_id, gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")), "conversations")
        turns_left = stretches.filter("whole").select(*keys, "roles", "texts").unionByName(left)
        shown = turns_left.select(conv_id, "part", "nth", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t"))
        return out, result(shown.select("conv_id", "part", "nth", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text")), "repaired")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: the rows of a table with the faults that the test asks for, by crc32 of conv_id and turn."""
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.pmod(F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))[0]


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT n, 0 AS k, n AS c FROM (SELECT unnest(range(256)) AS n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
keyed AS (SELECT *, list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))) AS b FROM conversations),
damaged AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS f FROM keyed, crc),
g AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM damaged, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
v AS (SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o || left(role, 1) AS pair FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k FROM v),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM w),
m(last, role, inserts) AS (VALUES ('-', 's', 0), ('-', 'u', 0), ('-', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'a', 0), ('u', 'u', 1), ('a', 'u', 0), ('a', 'a', 1)),
ops AS (SELECT last, 'D' AS op, last AS role, 0 AS inserts, 2 AS price FROM (VALUES ('-'), ('s'), ('u'), ('a')) v(last) UNION ALL SELECT last, 'K', role, inserts, 0 FROM m UNION ALL SELECT last, 'R', role, inserts, 1 FROM m WHERE role <> 's'),
ids AS (SELECT conv_id, max(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN x USING (conv_id) GROUP BY 1),
r AS (SELECT conv_id, 0 AS i, '-' AS last, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS b FROM ids
  UNION ALL SELECT r.conv_id, r.i + 1, o.role, min({'cost': r.b.cost + o.price + 5 * o.inserts + CASE WHEN o.op <> 'D' AND x.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': r.b.audit || repeat('I', o.inserts) || o.op,
    'lines': list_concat(r.b.lines, CASE WHEN o.inserts = 0 THEN [] WHEN o.role = 'a' THEN ['user:'] ELSE ['assistant:'] END, CASE o.op WHEN 'D' THEN [] WHEN 'K' THEN [x.role || ':' || x.text] ELSE [CASE o.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || x.text] END)})
  FROM r JOIN x ON x.conv_id = r.conv_id AND x.i = r.i + 1 JOIN ops o ON o.last = r.last AND (o.op = 'D' OR (x.fault NOT IN ('blank', 'duplicate') AND (o.op = 'R' OR o.role = left(x.role, 1)))) GROUP BY r.conv_id, r.i, o.role),
e AS (SELECT conv_id, min({'cost': b.cost + CASE last WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, 'audit': b.audit || CASE last WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END, 'lines': list_concat(b.lines, CASE last WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END)}) AS b FROM r JOIN ids USING (conv_id) WHERE i = coalesce(n, 0) GROUP BY 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256 FROM e LEFT JOIN c USING (conv_id)
"""
