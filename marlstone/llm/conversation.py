"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's roles must read ``(system? (user assistant)+)?``. Repairs are deductions of a weighted hypergraph: an item
(i, q) says that the first i rows are repaired and left the grammar in state q; with row i it derives (i + 1, q') by keeping,
reroling or deleting that row, and alone it derives (i, q') by inserting a row. A derivation weighs (cost, audit), the audit
being its edits' initials, and every deduction appends to both, so that it is monotone and superior: items are popped from
the agenda in the order of their weights, and an item is final when it is first popped. The agenda stops when the goal is.

A conversation may have any number of rows. Rows are sorted over range partitions and cut into blocks; most conversations
are one block and are solved where they lie. For the others each block derives its items from each of the four states, and
the blocks' items, which are short, are chained in order; a chain holds only the blocks on which the four states still
disagree. An insertion stands before a row that stays or at the end, never before a deleted one (the audit with the deletion
first is less), so at the same row no audit is the beginning of another, and weights compare block by block.

The digest of a repaired conversation is one hash over its text in order, so it is made in one stream of blocks, which
holds one block at a time; its audit is one string. Everything else of a long conversation is spread over its blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.storage import written_table

#: Rows and bytes of text of a block, at most; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Blocks that a chain passes before it looks for those that are settled.
SETTLE_EVERY = 64
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Fixed costs of keeping, reroling, deleting, inserting and of a truncated row that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
#: The state after a row with this initial; other pairs are not allowed.
NEXT = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_ASSISTANT, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT}
#: The role that a new or reroled row gets in each state.
WANTED = {START: "user", AFTER_SYSTEM: "user", AFTER_USER: "assistant", AFTER_ASSISTANT: "user"}
GOAL = "goal"
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int8())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])

Weight = tuple[int, str]


def fault_of(text: str, seen: bool) -> int:
    bare = text.encode().rstrip()
    return BLANK if not bare else DUPLICATE if seen else TRUNCATED if bare[-1] not in b".!?" else NO_FAULT


def edits(state: int, role: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row."""
    yield "D", COST["D"], state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if (kept := NEXT.get((state, role[:1]))) is not None:
            yield "K", COST["K"] + more, kept
        yield "R", COST["R"] + more, NEXT[state, WANTED[state][0]]


def lightest(rows: list[tuple[str, int]], start: int, whole: bool) -> dict[object, Weight]:
    """The lightest derivations over ``rows`` (role, fault) from ``start``: of the goal, and unless ``whole`` of each state at the end."""
    agenda: list[tuple[int, str, int, int, bool]] = [(0, "", 0, start, False)]
    final: set[tuple[int, int, bool]] = set()
    found: dict[object, Weight] = {}
    while agenda:
        cost, audit, i, state, inserted = heapq.heappop(agenda)
        if (i, state, inserted) in final:
            continue
        final.add((i, state, inserted))
        if i == len(rows):
            if not inserted:
                found.setdefault(state, (cost, audit))
            if state in (START, AFTER_ASSISTANT) and GOAL not in found:
                found[GOAL] = (cost, audit)
                if whole:
                    break
        else:
            for letter, weight, after in edits(state, *rows[i]):
                if not (inserted and letter == "D"):
                    heapq.heappush(agenda, (cost + weight, audit + letter, i + 1, after, False))
        heapq.heappush(agenda, (cost + COST["I"], audit + "I", i, NEXT[state, WANTED[state][0]], True))
    return found


def rewritten(rows: list[dict], audit: str, state: int) -> tuple[list[dict], int]:
    """The rows after the edits of ``audit``, and the state that they end in."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append({"role": WANTED[state], "text": ""})
        else:
            row = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append({"role": row["role"] if letter == "K" else WANTED[state], "text": row["text"]})
        state = NEXT[state, out[-1]["role"][:1]]
    return out, state


def audit_cost(rows: list[dict], audit: str) -> int:
    stays = [r["fault"] == TRUNCATED and e != "D" for r, e in zip(rows, audit.replace("I", ""))]
    return sum(COST[e] for e in audit) + TRUNCATED_COST * sum(stays)


def _block_batches(conv_type: pa.DataType, block_rows: int):
    """Rows in order to blocks of one conversation each."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # finished blocks that may still turn out to be at the end of the partition
        conv, rows, size, n_blocks, number, first_run, last = None, [], 0, 0, None, True, None

        def cut() -> None:
            nonlocal rows, size, n_blocks, number
            held.append((conv, number, n_blocks == 0, rows))
            rows, size, n_blocks, number = [], 0, n_blocks + 1, number + 1

        def out(at_edge: bool, more: bool) -> pa.RecordBatch:
            """What is held; a conversation is whole if it has one block, away from the partition's edges."""
            done = [(c, k, alone and not more and not at_edge, r) for c, k, alone, r in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.bool_()), pa.array([d[3] for d in done], pa.list_(_ROW))], ["conv_id", "block", "whole", "rows"])

        for batch in batches:
            ready: list[pa.RecordBatch] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "later", "part")]
            for c, turn, role, text, later, part in zip(*columns):
                if number is None:
                    number, conv = part << 33, c
                elif c != conv:
                    cut()
                    ready.append(out(first_run, n_blocks > 1))
                    conv, n_blocks, first_run, last = c, 0, False, None
                elif len(rows) >= block_rows or size + len(text) > BLOCK_BYTES:
                    cut()
                    ready.append(out(first_run, True))
                this = (turn, role, text)
                rows.append({"turn": turn, "role": role, "text": text, "fault": fault_of(text, later or this == last)})
                size, last = size + len(text), this
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if rows:
            cut()
            yield out(True, True)

    return blocks


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, block, whole, rows: blocks in the conversation's order; written."""
    key = F.md5(F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.concat("role", "text")))
    keyed = rows.withColumn("key", F.unhex(key)).withColumn("has_turn", F.col("turn").isNotNull())
    firsts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("has_turn", "turn")).alias("first")).where("n > 1").select("key", "first")
    later = F.coalesce((F.col("has_turn") != F.col("first.has_turn")) | (F.col("turn") > F.col("first.turn")), F.lit(False))
    met = keyed.join(firsts, "key", "left").withColumn("later", later)
    order = [F.col("conv_id"), F.col("has_turn"), F.col("turn"), F.substring("role", 1, 100), F.substring("text", 1, 100), F.col("key")]
    dealt = met.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "later", F.spark_partition_id().cast("long").alias("part"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return written_table(dealt.mapInArrow(_block_batches(to_arrow_type(rows.schema["conv_id"].dataType), block_rows), f"conv_id {kind}, block long, whole boolean, rows array<struct<turn: long, role: string, text: string, fault: tinyint>>"))


def _each(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    """Rows of the columns one by one, so that only one block's texts are Python objects."""
    for values in zip(*(batch.column(c) for c in columns)):
        yield tuple(v.as_py() for v in values)


def _measured(rows: list[dict]) -> dict:
    """What the counts need of a block: sums, and its ends."""
    turns, initials = [r["turn"] for r in rows if r["turn"] is not None], [r["role"][:1] for r in rows]
    return {
        "blank": sum(r["fault"] == BLANK for r in rows), "duplicate": sum(r["fault"] == DUPLICATE for r in rows), "truncated": sum(r["fault"] == TRUNCATED for r in rows),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "distinct_turns": len(set(turns)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first_initial": initials[0], "last_initial": initials[-1],
    }


_MEASURES = pa.struct([*((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct_turns", "first_turn", "last_turn")), ("first_initial", pa.string()), ("last_initial", pa.string())])
_SOLVED = "chunk string, cost long, measures struct<blank: long, duplicate: long, truncated: long, illegal: long, distinct_turns: long, first_turn: long, last_turn: long, first_initial: string, last_initial: string>, turns array<struct<role: string, text: string>>"


def _solved_batch(batch: pa.RecordBatch, columns: list[str], solve) -> Iterator[pa.RecordBatch]:
    chunk, cost, measures, turns = [], [], [], []
    for values in _each(batch, columns):
        rows, audit, state = solve(*values)
        chunk.append(audit), cost.append(audit_cost(rows, audit)), measures.append(_measured(rows)), turns.append(rewritten(rows, audit, state)[0])
    solved = [pa.array(chunk, pa.string()), pa.array(cost, pa.int64()), pa.array(measures, _MEASURES), pa.array(turns, pa.list_(_TURN))]
    yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *solved], ["conv_id", "block", "chunk", "cost", "measures", "turns"])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _solved_batch(batch, ["rows"], lambda rows: (rows, lightest([(r["role"], r["fault"]) for r in rows], START, True)[GOAL][1], START))


def _rewritten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _solved_batch(batch, ["rows", "chunk", "state"], lambda rows, chunk, state: (rows, chunk, state))


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, items: the lightest derivations of a block from each state to each, and to the goal (state 4)."""
    kind = pa.list_(pa.struct([("start", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        found = []
        for (rows,) in _each(batch, ["rows"]):
            plain = [(r["role"], r["fault"]) for r in rows]
            found.append([{"start": p, "end": 4 if q == GOAL else q, "cost": c, "audit": a} for p in STATES for q, (c, a) in lightest(plain, p, False).items()])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(found, kind)], ["conv_id", "block", "items"])


class Chain:
    """The lightest way through the blocks of one conversation, in their order."""

    def __init__(self):
        self.best = {START: (0, 0)}  # state: cost, rank of its audit
        self.layers: list[tuple[int, dict[int, tuple[int, str]]]] = []  # block, {state: (state before, chunk)}
        self.last: dict[int, tuple[int, int, str]] = {}  # ways to the goal by the last block: state before: cost, rank, chunk

    def add(self, block: int, items: list[dict]) -> None:
        ways: dict[int, tuple[int, int, str, int]] = {}
        self.last = {}
        for x in items:
            if x["start"] in self.best:
                cost, rank = self.best[x["start"]]
                way = (cost + x["cost"], rank, x["audit"], x["start"])
                if x["end"] == 4:
                    self.last[x["start"]] = way[:3]
                elif x["end"] not in ways or way < ways[x["end"]]:
                    ways[x["end"]] = way
        order = sorted(ways, key=lambda q: ways[q][1:3])
        self.best = {q: (ways[q][0], i) for i, q in enumerate(order)}
        self.layers.append((block, {q: (w[3], w[2]) for q, w in ways.items()}))

    def settled(self) -> list[tuple[int, int, str]]:
        """block, state before, chunk of the first blocks on which all ways agree; they are forgotten."""
        alive, at = set(self.best), len(self.layers)
        while at and len(alive) > 1:
            at -= 1
            alive = {self.layers[at][1][q][0] for q in alive}
        if len(alive) > 1 or at == 0:
            return []
        out = self._back(at, alive.pop())
        del self.layers[:at]
        return out

    def _back(self, at: int, state: int) -> list[tuple[int, int, str]]:
        out = []
        for block, ways in reversed(self.layers[:at]):
            state, chunk = ways[state]
            out.append((block, state, chunk))
        return out[::-1]

    def end(self) -> list[tuple[int, int, str]]:
        """The blocks that are left, the last one to the goal."""
        _, _, chunk, state = min((*w, q) for q, w in self.last.items())
        return [*self._back(len(self.layers) - 1, state), (self.layers[-1][0], state, chunk)]


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, state, chunk: what to do in each block of the conversations, whose blocks come in order."""
    chain, conv, n = None, None, 0

    def batch_of(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["block", "state", "chunk"])

    for batch in batches:
        found = []
        for c, block, items in _each(batch, ["conv_id", "block", "items"]):
            if chain is None or c != conv:
                found += chain.end() if chain else []
                chain, conv, n = Chain(), c, 0
            chain.add(block, items)
            n += 1
            if n % SETTLE_EVERY == 0:
                found += chain.settled()
        yield batch_of(found)
    if chain:
        yield batch_of(chain.end())


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, block, chunk (edits), cost, measures and turns (role and text after repair) of each block of conversations.

    ``rows`` has conv_id, turn (long), role and text. A conversation's blocks in ascending order are the conversation.
    """
    blocks = blocks_of(rows, block_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, block long, {_SOLVED}"
    whole = blocks.where("whole").mapInArrow(_whole, schema)
    long = blocks.where("not whole").select("conv_id", "block", "rows")
    items = long.mapInArrow(_items, f"conv_id {kind}, block long, items array<struct<start: tinyint, end: tinyint, cost: long, audit: string>>")
    chunks = items.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chained, "block long, state int, chunk string")
    return whole.unionByName(long.join(chunks, "block").select("conv_id", "block", "rows", "chunk", "state").mapInArrow(_rewritten, schema))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, whose blocks come in order: counts, audit and the digest of its repaired rows."""
    conv, state = None, None

    def fresh() -> dict:
        return {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "low": None, "high": None, "initial": None, "audit": [], "hash": hashlib.sha256(), "lines": 0}

    def row_of(c: object, s: dict) -> tuple:
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        return (c, gaps, *(s[k] for k in _COUNTS[1:]), "".join(s["audit"]), s["hash"].hexdigest())

    def batch_of(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 9
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    kind = None
    for batch in batches:
        found, kind = [], batch.schema.field("conv_id").type
        for c, chunk, cost, m, turns in _each(batch, ["conv_id", "chunk", "cost", "measures", "turns"]):
            if state is None or c != conv:
                found += [row_of(conv, state)] if state else []
                conv, state = c, fresh()
            for k in ("blank", "duplicate", "truncated", "illegal"):
                state[k] += m[k]
            state["cost"] += cost
            state["illegal"] += state["initial"] is not None and state["initial"] + m["first_initial"] not in ("su", "ua", "au")
            state["initial"] = m["last_initial"]
            if m["first_turn"] is not None:
                state["turns"] += m["distinct_turns"] - (state["high"] == m["first_turn"])
                state["low"], state["high"] = m["first_turn"] if state["low"] is None else state["low"], m["last_turn"]
            state["audit"].append(chunk)
            for t in turns:
                state["hash"].update((b"\n" if state["lines"] else b"") + f"{t['role']}:{t['text']}".encode())
                state["lines"] += 1
        yield batch_of(found, kind)
    if state:
        yield batch_of([row_of(conv, state)], kind)


def repair_summary(rows: DataFrame, ids: DataFrame | None = None, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; turn a long), and for each other conv_id of ``ids``.

    conv_id, gaps (turns that are missing between the first and the last), blank, duplicate, truncated (rows by their first
    fault), illegal (neighbours whose initials are not su, ua or au), cost, audit and repaired_sha256 (of ``role:text`` joined by
    newlines). Rows stand in the order of turn (null first), and rows of one turn in the order of role and text.

    A null role or text is one space. A role counts by its first character; an empty role has none and can't be kept. A null
    conv_id is a conversation of its own. Rows that are equal in all columns are duplicates of the first. An id without rows
    has zeros, an empty audit and the digest of the empty string. An empty table gives an empty result. Other columns of
    ``rows`` are not read, whatever their names.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = repaired(rows, block_rows).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    found = blocks.mapInArrow(_summed, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    if ids is None:
        return found
    wanted = ids.select(F.col("conv_id").alias("__id")).distinct()
    met = wanted.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    return met.select(F.col("__id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's. A null is one space."""
    space = F.lit(" ")
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


#: crc32 by its table of 256 numbers, then the states' lightest audits row by row.
ORACLE_SQL = r"""
WITH RECURSIVE
bits AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 20 AS kind FROM src, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
ids AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
num AS (
  SELECT ids.c, turn, role, text, row_number() OVER (PARTITION BY ids.c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM dam JOIN ids ON dam.conv_id IS NOT DISTINCT FROM ids.conv_id),
flt AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS b, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM num),
move(q, b, r, letter, cost) AS (VALUES
  (0, '*', 0, 'D', 2), (1, '*', 1, 'D', 2), (2, '*', 2, 'D', 2), (3, '*', 3, 'D', 2),
  (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0),
  (0, '*', 2, 'R', 1), (1, '*', 2, 'R', 1), (3, '*', 2, 'R', 1), (2, '*', 3, 'R', 1),
  (0, 'a', 3, 'IK', 5), (1, 'a', 3, 'IK', 5), (3, 'a', 3, 'IK', 5), (2, 'u', 2, 'IK', 5),
  (0, '*', 3, 'IR', 6), (1, '*', 3, 'IR', 6), (3, '*', 3, 'IR', 6), (2, '*', 2, 'IR', 6)),
path AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM ids
  UNION ALL
  SELECT c, i, q, cost, audit FROM (
    SELECT p.c, f.i, m.r AS q, p.cost + m.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END AS cost, p.audit || letter AS audit,
           row_number() OVER (PARTITION BY p.c, m.r ORDER BY p.cost + m.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END, p.audit || letter) AS k
    FROM path p JOIN flt f ON f.c = p.c AND f.i = p.i + 1 JOIN move m ON m.q = p.q AND m.b IN ('*', f.b) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))) WHERE k = 1),
tot AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || b NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY c),
best AS (
  SELECT c, cost, audit FROM (
    SELECT path.c, cost + e.more AS cost, audit || e.tail AS audit, row_number() OVER (PARTITION BY path.c ORDER BY cost + e.more, audit || e.tail) AS k
    FROM path JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 5, 'I'), (1, 10, 'II')) e(q, more, tail) USING (q) LEFT JOIN tot USING (c) WHERE path.i = coalesce(n, 0)) WHERE k = 1),
step AS (SELECT c, letter, pos, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS o
  FROM (SELECT c, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS pos FROM best WHERE audit <> '') WINDOW w AS (PARTITION BY c ORDER BY pos)),
kept AS (SELECT s.c, s.o, letter, role, text, max(CASE WHEN s.o = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS sys
  FROM step s LEFT JOIN num f ON f.c = s.c AND f.i = s.i AND s.letter <> 'I' WHERE letter <> 'D'),
fixed AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS t FROM kept GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best.cost::BIGINT AS cost, best.audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN tot USING (c) LEFT JOIN fixed USING (c)
"""
