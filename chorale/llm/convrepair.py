"""Repair of damaged conversations by the cheapest edits that give a legal order of roles.

A legal conversation is an optional system message and then pairs of a user's and an assistant's. Spark brings the rows of
a conversation together in order; each task buckets its conversations by length and lays a bucket out time-major, as a
tensor of turns x conversations. Walking back over the turns updates the costs of all conversations at once (the
backward costs, stored), and walking forward again traces every conversation's edits, the least letter first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays costs CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Turns whose backward costs are kept at once; of longer conversations only every BLOCK-th turn's are, and the rest come again.
BLOCK = 4096
#: Bytes of one conversation that a task holds; what is beyond waits in a file of the task.
HELD = 64 << 20
#: Classes of roles by their initials (0: any other), and what an edit writes.
CLASSES, NAMES = {"s": 1, "u": 2, "a": 3}, {2: "user", 3: "assistant"}
#: States: nothing yet, after system, after user, after assistant. NEXT is the state that a kept row of a class leads to (4: none),
#: WRITES the class that an inserted or changed row must have, which is also the state it leads to.
NEXT = np.array([[4, 1, 2, 4], [4, 4, 2, 4], [4, 4, 4, 3], [4, 4, 2, 4]])
WRITES = np.array([2, 2, 3, 2])
NEVER = 1 << 60
_FLAGS = {"blank": 4, "truncated": 8, "dropped": 16}


def damage(conversations: DataFrame) -> DataFrame:
    """The rows as a fixed damage leaves them, and ``dropped``: by crc32(``conv_id:turn``) % 20, 0 drops a row (it stays, marked
    and without text), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Missing values are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("time", F.explode(times)).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"))


def _marked(turns: DataFrame) -> DataFrame:
    """What the tasks read: whole conversations, in order of turn (missing first), role and text."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = value("role"), value("text")
    end = F.substring(F.rtrim(text, F.lit(SPACE_CHARS)), -1, 1)
    initial = F.substring(role, 1, 1)
    cls: Column = F.lit(0)
    for name, code in CLASSES.items():
        cls = F.when(initial == name, code).otherwise(cls)
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    flags = cls + F.when(end == "", _FLAGS["blank"]).otherwise(0) + F.when(end.isin(".", "!", "?"), 0).otherwise(_FLAGS["truncated"]) + F.when(dropped, _FLAGS["dropped"]).otherwise(0)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), flags.cast("int").alias("flags"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs [turn, state, conversation] of the cheapest edits from a turn on; ``codes`` [turn, conversation] has the class, 4 if
    the row must go, 8 if it is truncated, 16 if there is no row; ``end`` [state, conversation] is what follows the last turn."""
    turns, many = codes.shape
    costs = np.empty((turns + 1, 4, many), np.int64)
    costs[turns] = _inserted(end)
    never, each = np.full((1, many), NEVER), np.arange(many)
    for t in range(turns - 1, -1, -1):
        after, code = np.concatenate([costs[t + 1], never]), codes[t]
        stays = np.where(code & 4, NEVER, np.where(code & 8, CUT, 0))
        kept = after[NEXT[:, code & 3], each] + stays
        changed = after[WRITES] + stays + REROLE
        best = np.minimum(np.minimum(kept, changed), after[:4] + DELETE)
        costs[t] = np.where(code & 16, after[:4], _inserted(np.minimum(best, NEVER)))
    return costs


def _inserted(costs: np.ndarray) -> np.ndarray:
    """The costs if rows may be inserted first: two, after which a state would come back, are enough."""
    for _ in range(2):
        costs = np.minimum(costs, costs[WRITES] + INSERT)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: bool) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Edits as steps (conversations, turn, letters, classes written) in order, and the state that each conversation ends in."""
    steps, each, state = [], np.arange(codes.shape[1]), state.copy()

    def insert(t: int, able: np.ndarray) -> None:
        """Insert where this is the cheapest and no letter before it is."""
        while able.any():
            able &= INSERT + costs[t, WRITES[state], each] == costs[t, state, each]
            if t < len(codes):
                able &= DELETE + costs[t + 1, state, each] != costs[t, state, each]
            rows = np.flatnonzero(able)
            if len(rows):
                state[rows] = WRITES[state[rows]]
                steps.append((rows, -1, np.full(len(rows), ord("I")), state[rows]))

    for t, code in enumerate(codes):
        there = code & 16 == 0
        insert(t, there.copy())
        now, after = costs[t, state, each], costs[t + 1]
        gone = there & (DELETE + after[state, each] == now)
        to = NEXT[state, code & 3]
        keeps = there & ~gone & (to < 4) & (code & 4 == 0)
        keeps &= np.where(code & 8, CUT, 0) + after[np.minimum(to, 3), each] == now
        rows = np.flatnonzero(there)
        letter = np.where(gone, ord("D"), np.where(keeps, ord("K"), ord("R")))
        state = np.where(~there | gone, state, np.where(keeps, to, WRITES[state]))
        steps.append((rows, t, letter[rows], np.where(letter[rows] == ord("R"), state[rows], 0)))
    if last:
        insert(len(codes), np.ones(len(each), bool))
    return steps, state


def solve(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest edits of conversations whose rows' codes stand one after another: the costs, and for each edit in order its
    conversation, row (-1: inserted), letter and the class it writes (0: none)."""
    cost, found = np.zeros(len(sizes), np.int64), []
    starts = np.cumsum(sizes) - sizes
    end = np.array([[0], [NEVER], [NEVER], [0]])
    buckets = np.where(sizes > BLOCK, -1 - np.arange(len(sizes)), np.frexp(np.maximum(sizes, 1))[1])
    for bucket in np.unique(buckets[sizes > 0]):
        own = np.flatnonzero((buckets == bucket) & (sizes > 0))
        size = sizes[own]
        turns = np.arange(size.max())[:, None]
        rows = np.where(turns < size, starts[own] + turns, -1)
        tensor = np.where(rows < 0, 16, codes[rows]).astype(np.int64)
        blocks = range(0, len(tensor), BLOCK)
        ends = [np.repeat(end, len(own), 1)]
        for b in reversed(blocks[1:]):
            ends.append(backward(tensor[b : b + BLOCK], ends[-1])[0])
        state = np.zeros(len(own), np.int64)
        for b in blocks:
            costs = backward(tensor[b : b + BLOCK], ends.pop())
            if not b:
                cost[own] = costs[0, 0]
            steps, state = trace(tensor[b : b + BLOCK], costs, state, last=b + BLOCK >= len(tensor))
            edits_ = [(own[which], rows[b + t, which] if t >= 0 else np.full(len(which), -1), letter, role) for which, t, letter, role in steps]
            found.append(tuple(np.concatenate(x) for x in zip(*edits_)))
    if not found:
        return cost, *(np.zeros(0, np.int64) for _ in range(4))
    conv, row, letter, role = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(conv, kind="stable")
    return cost, conv[order], row[order], letter[order], role[order]


class _Spool:
    """Rows of one conversation in order; beyond HELD bytes their roles and texts wait in a file that goes with the object."""

    def __init__(self) -> None:
        self.thin: list[pa.RecordBatch] = []
        self.held: list[pa.RecordBatch] = []
        self.bytes, self.file = 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.thin.append(batch.select(["conv_id", "turn", "flags", "h1", "h2"]))
        self.held.append(batch.select(["role", "text"]))
        self.bytes += batch.nbytes
        if self.bytes > HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # the task's own, like Spark's spilled rows
                self.writer = pa.ipc.new_stream(self.file, self.held[0].schema)
            for x in self.held:
                self.writer.write_batch(x)
            self.held, self.bytes = [], 0

    def texts(self) -> Iterator[pa.RecordBatch]:
        if self.file is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
        yield from self.held


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[_Spool]:
    """The conversations of sorted batches, whole: many at once, or the one that ends a batch together with what follows."""
    tail, name = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"]
        codes = ids.dictionary_encode("encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
        if tail is not None and ids[0].as_py() == name:
            tail.add(batch.slice(0, cuts[1]))
            cuts = cuts[1:]
        if len(cuts) > 1:
            if tail is not None:
                yield tail
            if len(cuts) > 2:
                head = _Spool()
                head.add(batch.slice(cuts[0], cuts[-2] - cuts[0]))
                yield head
            tail, name = _Spool(), ids[len(codes) - 1].as_py()
            tail.add(batch.slice(cuts[-2]))
    if tail is not None:
        yield tail


class _Repaired:
    """The repair of some whole conversations, as arrays."""

    def __init__(self, spool: _Spool):
        thin = pa.Table.from_batches(spool.thin).combine_chunks()
        names = pa.concat_arrays(thin["conv_id"].chunks)
        first = np.concatenate([[0], np.flatnonzero(np.diff(names.dictionary_encode("encode").indices.to_numpy())) + 1])
        self.spool, self.ids, self.many = spool, names.take(pa.array(first)), len(first)
        flags = thin["flags"].to_numpy()
        self.row = np.flatnonzero(flags & _FLAGS["dropped"] == 0)  # rows of the table that are there
        self.conv = (np.searchsorted(first, np.arange(len(flags)), "right") - 1)[self.row]
        flags = flags[self.row]
        self.sizes = np.bincount(self.conv, minlength=self.many)
        self.blank = flags & _FLAGS["blank"] != 0
        h1, h2 = (thin[h].to_numpy()[self.row] for h in ("h1", "h2"))
        order = np.lexsort((h2, h1, self.conv))  # stable: rows stay in order
        again, this, before = np.zeros(len(order), bool), order[1:], order[:-1]
        again[this] = (self.conv[this] == self.conv[before]) & (h1[this] == h1[before]) & (h2[this] == h2[before])
        self.duplicate = again & ~self.blank
        self.truncated = (flags & _FLAGS["truncated"] != 0) & ~self.blank & ~self.duplicate
        self.cls = flags & 3
        codes = self.cls + np.where(self.blank | self.duplicate, 4, 0) + np.where(self.truncated, 8, 0)
        self.cost, self.edit_conv, self.edit_row, self.letter, self.role = solve(codes, self.sizes)
        turn = thin["turn"].take(pa.array(self.row))
        self.known, self.turn = turn.is_valid().to_numpy(), turn.fill_null(0).to_numpy()

    def counts(self) -> dict[str, np.ndarray]:
        count = lambda mask, conv=self.conv: np.bincount(conv[mask], minlength=self.many)
        same = self.conv[1:] == self.conv[:-1]
        pair = self.cls[:-1] * 4 + self.cls[1:]
        conv, turn = self.conv[self.known], self.turn[self.known]
        gaps = np.zeros(self.many, np.int64)
        if len(conv):
            new = np.concatenate([[True], conv[1:] != conv[:-1]])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(conv)) - 1
            distinct = np.add.reduceat((new | np.concatenate([[True], turn[1:] != turn[:-1]])).astype(np.int64), start)
            gaps[conv[start]] = turn[end] - turn[start] + 1 - distinct
        return {"gaps": gaps, "blank": count(self.blank), "duplicate": count(self.duplicate), "truncated": count(self.truncated), "illegal": count(same & ~np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2)), self.conv[1:]), "cost": self.cost}

    def messages(self) -> Iterator[tuple[int, int, int, str, str]]:
        """Each edit in order: its place among all, conversation, row (-1: none), role and text; deleted ones have the row's own."""
        texts, base, roles, lines = self.spool.texts(), 0, [], pa.array([], pa.string())
        for start in range(0, len(self.letter), BLOCK):
            part = slice(start, start + BLOCK)
            for e, conv, row, role in zip(range(start, len(self.letter)), self.edit_conv[part].tolist(), self.edit_row[part].tolist(), self.role[part].tolist()):
                if row < 0:
                    yield e, conv, -1, NAMES[role], ""
                    continue
                place = int(self.row[row])
                while place >= base + len(roles):
                    base += len(roles)
                    batch = next(texts)
                    roles, lines = batch["role"].to_pylist(), batch["text"]
                yield e, conv, row, NAMES[role] if role else roles[place - base], lines[place - base].as_py()


_EDITS = "step long, turn long, edit string, fault string, role string, text string"
_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _schema(turns: DataFrame, rest: str) -> str:
    return f"conv_id {dict(turns.dtypes)['conv_id']}, {rest}"


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for spool in _whole(batches):
        found = _Repaired(spool)
        hashes, empty = [sha256() for _ in range(found.many)], np.ones(found.many, bool)
        for e, conv, _, role, text in found.messages():
            if found.letter[e] != ord("D"):
                hashes[conv].update(f"{role}:{text}".encode() if empty[conv] else f"\n{role}:{text}".encode())
                empty[conv] = False
        letters, bounds = found.letter.astype(np.uint8).tobytes().decode("ascii"), np.searchsorted(found.edit_conv, np.arange(found.many + 1)).tolist()
        audit = [letters[a:b] for a, b in zip(bounds, bounds[1:])]
        counts = {k: pa.array(v, pa.int64()) for k, v in found.counts().items()}
        yield pa.RecordBatch.from_arrays([found.ids, *counts.values(), pa.array(audit, pa.string()), pa.array([h.hexdigest() for h in hashes], pa.string())], ["conv_id", *counts, "audit", "repaired_sha256"])


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "step", "turn", "edit", "fault", "role", "text"]
    for spool in _whole(batches):
        found = _Repaired(spool)
        first, rows = np.searchsorted(found.edit_conv, np.arange(found.many)), []
        ids = found.ids.to_pylist()
        kind = found.ids.type

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.int64(), *[pa.string()] * 4))], names)

        for e, conv, row, role, text in found.messages():
            fault = None if row < 0 else "blank" if found.blank[row] else "duplicate" if found.duplicate[row] else "truncated" if found.truncated[row] else None
            turn = int(found.turn[row]) if row >= 0 and found.known[row] else None
            rows.append((ids[conv], int(e - first[conv]), turn, chr(found.letter[e]), fault, role, text))
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def edits(turns: DataFrame) -> DataFrame:
    """One row for each edit of the conversations: conv_id, step (from 0), turn (null: inserted, or missing), edit (Keep, Rerole,
    Delete, Insert by its initial), fault (blank, duplicate, truncated or null), role and text as they are after it (a deleted
    row's own). The rows whose edit isn't D, in order of step, are the repaired conversation.

    ``turns`` has conv_id, turn, role, text and perhaps a boolean ``dropped``, whose rows count as not there; other columns are
    left out, whatever their names. Missing roles and texts are one space, a missing conv_id is a conversation of its own, rows
    of one turn are ordered by role and text, and a role without an initial can't be kept. An empty table gives an empty result.
    """
    return _marked(turns).mapInArrow(_edit_rows, _schema(turns, _EDITS))


def audit(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its turns' gaps, counts of faults and illegal neighbours, the edits' cost and initials, and
    the hash of what ``edits`` repairs it to. Odd rows are as ``edits`` has them; a conversation whose rows are all dropped has
    zeros, no edits and the hash of nothing. One conversation is one task's work, as its hash and audit are single values; a task
    holds its rows' codes and HELD bytes of its texts, however long it is.
    """
    return _marked(turns).mapInArrow(_audit_rows, _schema(turns, _AUDIT))


def repair_digest(conversations: DataFrame) -> DataFrame:
    """``audit`` of the conversations after ``damage``; missing values, ties, repeated rows and an empty table are as there."""
    return audit(damage(conversations.select("conv_id", "turn", "role", "text")))


_INSERTED = "{'c': least({0}.c + 5, 1000000000), 'a': {0}.a || 'I', 'r': list_append({0}.r, '{1}:')}"
_U = f"list_min([s2, {_INSERTED.replace('{0}', 's0').replace('{1}', 'user')}, {_INSERTED.replace('{0}', 's1').replace('{1}', 'user')}, {_INSERTED.replace('{0}', 's3').replace('{1}', 'user')}])"
_A = f"list_min([s3, {_INSERTED.replace('{0}', 's2').replace('{1}', 'assistant')}])"


def _to(state: str, cost: str, letter: str, line: str | None) -> str:
    """A state's struct after a row's edit."""
    return f"{{'c': least({state}.c + {cost}, 1000000000), 'a': {state}.a || '{letter}', 'r': {f'list_append({state}.r, {line})' if line else f'{state}.r'}}}"


def _keep(state: str, initial: str) -> str:
    return _to(state, f"CASE WHEN must OR left(role, 1) <> '{initial}' OR role = '' THEN 1000000000 ELSE cut END", "K", "role || ':' || text")


def _change(state: str, role: str) -> str:
    return _to(state, "CASE WHEN must THEN 1000000000 ELSE cut + 1 END", "R", f"'{role}:' || text")


#: The same in DuckDB: forward, a turn of all conversations at a time, with the cheapest and least edits that lead to each state.
REPAIR_SQL = f"""
WITH RECURSIVE steps AS (SELECT i AS byte, 0 AS step, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM steps WHERE step = 8),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS time FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM r),
f AS MATERIALIZED (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS dup, left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY p), 1) AS pair FROM o),
x AS MATERIALIZED (SELECT *, blank OR dup AS must, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS truncated, CASE WHEN truncated THEN 5 ELSE 0 END AS cut FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
em AS (SELECT conv_id, 0 AS p, s0, s1, s2, {_A} AS s3 FROM (SELECT conv_id, s0, s1, s3, {_U} AS s2 FROM (SELECT conv_id, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s1, s1 AS s2, s1 AS s3 FROM ids))
  UNION ALL SELECT conv_id, p, s0, s1, s2, {_A} AS s3 FROM (SELECT conv_id, p, s0, s1, s3, {_U} AS s2 FROM (SELECT em.conv_id, x.p,
    {_to('s0', '2', 'D', None)} AS s0,
    list_min([{_to('s1', '2', 'D', None)}, {_keep('s0', 's')}]) AS s1,
    list_min([{_to('s2', '2', 'D', None)}, {_keep('s0', 'u')}, {_keep('s1', 'u')}, {_keep('s3', 'u')}, {_change('s0', 'user')}, {_change('s1', 'user')}, {_change('s3', 'user')}]) AS s2,
    list_min([{_to('s3', '2', 'D', None)}, {_keep('s2', 'a')}, {_change('s2', 'assistant')}]) AS s3
    FROM em JOIN x ON em.conv_id IS NOT DISTINCT FROM x.conv_id AND x.p = em.p + 1))),
best AS (SELECT conv_id, list_min([s0, s3]) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS back FROM em) WHERE back = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  s.c AS cost, s.a AS audit, sha256(array_to_string(s.r, chr(10))) AS repaired_sha256 FROM best LEFT JOIN c ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
