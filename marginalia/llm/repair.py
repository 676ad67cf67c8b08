"""Conversation structure repair: the cheapest edits that give ``(system? (user assistant)+)?``.

Each row of a conversation is kept (cost 0), gets the role user or assistant (1) or is deleted
(2); empty turns of a user or an assistant may be inserted anywhere (5). Blank and duplicate rows
must be deleted, a truncated row that stays adds 5. Of the cheapest edits those whose initials
D, I, K, R are least as text are taken.

Faults (the first that holds): blank (nothing but white space of ASCII), duplicate (role and text stood
earlier in the conversation, in a row with any fault), truncated (the last character that isn't such white
space is none of ``.!?``).

Decoding is Viterbi over four states: nothing yet, behind a system turn, behind a user turn,
behind an assistant turn. Survivors end in a tree of backpointers whose nodes count their
references. A node that no survivor needs any more is freed; as soon as all survivors have an
ancestor in common, its edits are final, are emitted, and the rows they belong to are forgotten. A state that
another one beats whatever follows is dropped, as a survivor without hope would hold the tree
open, and a stretch of deletions on one branch is one node, so forced deletions cost no memory. Paths of
equal cost are compared by their complete undecided suffixes, whose order is kept as ranks. So memory is
that of the longest undecided stretch, not of the conversation (many user turns in a row are one: which of them
becomes the assistant's depends on what follows).

Spark marks duplicates with a window, deals rows to tasks by conversation and sorts them; a task
reads its conversations one row at a time. Edits are rows, so a conversation of any length is
never one value; only ``report`` makes one row, with one letter per edit, of each. The digest that it makes
is a chain over the conversation, so one conversation's rows pass through one task, in order.

Nulls and ties: a null role or text is one space. Rows are ordered by turn (nulls first), then role and
text by code point. A null conv_id is a conversation of its own. Repeated rows are duplicates. Columns besides conv_id, turn,
role, text and ``dropped`` are not read and may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Where a kept row of this initial leads, and where a user or assistant turn leads that is put there.
_KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: Edits of one output batch.
BATCH = 4096


class _Node:
    """An edit, or ``n`` deletions in a row; refs: its kids and the survivors that end here."""

    __slots__ = ("edit", "kids", "n", "parent", "refs")

    def __init__(self, parent: _Node | None, edit: str):
        self.parent, self.edit, self.n, self.refs, self.kids = parent, edit, 1, 0, set()
        if parent:
            parent.refs += 1
            parent.kids.add(self)


class Decoder:
    """Takes a conversation's rows one by one and returns edits as soon as they are final.

    A survivor's edits are those up to the last row and some inserts behind it. The former never begin one
    another, so a rank among the (at most four) survivors orders them by their complete undecided
    suffixes, and the ranks of one step give those of the next: a tie costs no walk over the suffixes.
    """

    def __init__(self):
        self.root = _Node(None, "")
        #: By state: cost, rank of the edits up to the last row, inserts behind it, node.
        self.alive: dict[int, tuple[int, int, str, _Node]] = {}
        self._settle({NOTHING: (0, (0, ""), self.root, "")})

    def step(self, initial: str, fault: str | None) -> list[tuple[str, int]]:
        """(edit, how often) of what became final."""
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, rank: int, tail: str, node: _Node, edit: str) -> None:
            made = (cost, (rank, tail + edit), node, edit)
            if state not in best or made[:2] < best[state][:2]:
                best[state] = made

        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, *path) in self.alive.items():
            offer(state, cost + DELETE, *path, "D")
            if fault in (None, "truncated"):
                kept = _KEEP.get(initial, {}).get(state)
                if kept is not None:
                    offer(kept, cost + stays, *path, "K")
                offer(_TURN[state], cost + REROLE + stays, *path, "R")
        self._settle(best)
        return self._final()

    def end(self) -> list[tuple[str, int]]:
        """The rest of the edits; the decoder is used up."""
        out, node = [], min(self.alive[s] for s in (NOTHING, ASSISTANT) if s in self.alive)[-1]
        while node is not self.root:
            out.append((node.edit, node.n))
            node = node.parent
        return out[::-1]

    def _settle(self, best: dict[int, tuple]) -> None:
        """The best offers become survivors; then turns are inserted where that is cheaper, two at most as a third repeats a state."""
        before = [x[-1] for x in self.alive.values()]
        ranks = {key: n for n, key in enumerate(sorted({key for _, key, _, _ in best.values()}))}
        self.alive = {state: (cost, ranks[key], "", self._held(node, edit)) for state, (cost, key, node, edit) in best.items()}
        for _ in range(2):
            for state in list(self.alive):
                cost, rank, tail, node = self.alive[state]
                to, made = _TURN[state], (cost + INSERT, rank, tail + "I")
                held = self.alive.get(to)
                if held is None or made < held[:3]:
                    self.alive[to] = (*made, self._held(node, "I"))
                    if held:
                        self._release(held[-1])
        for node in before:
            self._release(node)
        # what may follow NOTHING costs at most 2 more behind ASSISTANT (a system turn is deleted there), what may follow SYSTEM no more
        for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            if state in self.alive and ASSISTANT in self.alive and self.alive[ASSISTANT][0] + more < self.alive[state][0]:
                self._release(self.alive.pop(state)[-1])
        for *_, node in self.alive.values():
            self._joined(node)

    def _held(self, parent: _Node, edit: str) -> _Node:
        node = _Node(parent, edit) if edit else parent
        node.refs += 1
        return node

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            parent = node.parent
            parent.kids.discard(node)
            parent.refs -= 1
            node = parent
        if node.refs == 1 and len(node.kids) == 1:
            self._joined(next(iter(node.kids)))

    def _joined(self, node: _Node) -> None:
        """A deletion takes in the deletions right before it that nothing else refers to."""
        while node.edit == "D" and (before := node.parent) is not self.root and before.edit == "D" and before.refs == 1:
            node.n += before.n
            node.parent = before.parent
            node.parent.kids.discard(before)
            node.parent.kids.add(node)

    def _final(self) -> list[tuple[str, int]]:
        out = []
        while self.root.refs == 1 and self.root.kids:
            self.root = next(iter(self.root.kids))
            self.root.parent = None
            out.append((self.root.edit, self.root.n))
        return out


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, fault; the texts of rows that can't stay are left out.

    A column ``dropped`` of rows says which of them don't count; they only keep their conversation in the result.
    """
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    blank = F.length(F.translate("text", _BLANK, "")) == 0
    aside = F.col("dropped") | blank  # can't be duplicates; dealt by turn, so that many of them are no hot key
    same = F.when(aside, F.concat(F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit("")))).otherwise(F.md5(F.concat_ws("\n", F.col("role"), F.col("text"))))
    earlier = F.row_number().over(Window.partitionBy("conv_id", same).orderBy(F.col("turn").asc_nulls_first())) > 1
    open_end = ~F.coalesce(F.substring(F.rtrim(F.translate("text", _BLANK, " ")), -1, 1), F.lit("")).isin(".", "!", "?")
    fault = F.when(F.col("dropped"), F.lit(None)).when(blank, "blank").when(earlier, "duplicate").when(open_end, "truncated")
    return said.withColumn("fault", fault)


EDITS = "conv_id {0}, place long, edit string, role string, text string, turn {1}, was string, fault string, cost long"


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order, one row each.

    conv_id, place (from 0), edit (keep, rerole, delete or insert), role and text after it (null if deleted), turn, was (the role
    before) and fault of the row it belongs to (null if inserted), cost. A conversation of which no row counts has one row whose edit is null. A partition holds whole
    conversations, one after the other.
    """
    found = with_faults(rows)
    order = [F.col("conv_id"), F.col("dropped"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.coalesce(F.col("fault") == "duplicate", F.lit(False))]
    schema = StructType.fromDDL(EDITS.format(found.schema["conv_id"].dataType.simpleString(), found.schema["turn"].dataType.simpleString()))
    dealt = found.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        for edit in _edits(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")), strict=True)):
            out.append(edit)
            if len(out) == BATCH:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


_NAMES = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of EDITS for sorted rows (conv_id, turn, role, text, dropped, fault)."""
    none = object()
    conv, decoder, waiting, state, place = none, Decoder(), deque(), NOTHING, 0

    def emitted(final: list[tuple[str, int]]) -> Iterator[tuple]:
        nonlocal state, place
        for edit, n in final:
            for _ in range(n):
                turn = role = text = was = fault = None
                cost = INSERT
                if edit != "I":
                    turn, was, text, fault = waiting.popleft()
                    cost = {"D": DELETE, "K": 0, "R": REROLE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit == "D":
                    text = None
                elif edit == "K":
                    state, role = _KEEP[was[:1]][state], was
                else:
                    state = _TURN[state]
                    role, text = _ROLE[state], text if edit == "R" else ""
                yield conv, place, _NAMES[edit], role, text, turn, was, fault, cost
                place += 1

    def closed() -> Iterator[tuple]:
        if conv is not none:
            yield from emitted(decoder.end())
            if not place:
                yield conv, None, None, None, None, None, None, None, 0

    for conv_id, turn, role, text, dropped, fault in rows:
        if conv is none or conv_id != conv:
            yield from closed()
            conv, decoder, state, place = conv_id, Decoder(), NOTHING, 0
        if not dropped:
            waiting.append((turn, role, text if fault in (None, "truncated") else None, fault))
            yield from emitted(decoder.step(role[:1], fault))
    yield from closed()


REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = frozenset({"su", "ua", "au"})


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation of what repaired() gives: gaps of its turns, faults, cost, the edits' initials and the SHA-256 of the repaired ``role:text`` lines.

    It reads the edits in the order in which repaired() makes them, without a shuffle.
    """
    schema = StructType.fromDDL(REPORT.format(edits.schema["conv_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        none = object()
        conv, out, said, digest, first, last, turns, before = none, {}, [], hashlib.sha256(), True, None, [], None

        def row() -> pa.RecordBatch:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            values = (conv, gaps, out["blank"], out["duplicate"], out["truncated"], out["illegal"], out["cost"], "".join(said), digest.hexdigest())
            return _batch([values], arrow)

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for conv_id, place, edit, role, text, turn, was, fault, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is none or conv_id != conv or not place:
                    if conv is not none:
                        done.append(row())
                    conv, out, said, digest = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], hashlib.sha256()
                    first, last, turns, before = True, None, [], None
                if edit is None:
                    continue
                out["cost"] += cost
                said.append(edit[0].upper())
                if role is not None:
                    digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
                if edit != "insert":
                    if fault:
                        out[fault] += 1
                    out["illegal"] += before is not None and before[:1] + was[:1] not in _LEGAL
                    before = was
                    if turn is not None and turn != last:
                        turns, last = [turns[0], turn, turns[2] + 1] if turns else [turn, turn, 1], turn
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if conv is not none:
            yield row()

    return edits.mapInArrow(run, schema)


#: What damaged() does to a row, by the CRC-32 of ``conv_id:turn`` modulo KINDS.
DROPPED, EMPTIED, CUT, REPEATED, ROLE = range(5)
KINDS = 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by crc32(``conv_id:turn``) % 20: 0 drops the row (dropped is true), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. A null is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(KINDS))
    kinds = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == CUT, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == ROLE, "user").otherwise(F.col("role"))
    out = kinds.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == DROPPED).alias("dropped"), F.when(F.col("kind") == REPEATED, 2).otherwise(1).alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _then(path: str, cost: str, edit: str, line: str | None = None, only: str | None = None) -> str:
    """A path and one more edit; out of the question unless ``only`` holds."""
    text = f"{path}.t" if line is None else f"CASE WHEN {path}.t = '' THEN {line} ELSE {path}.t || chr(10) || {line} END"
    c = f"{path}.c + {cost}" if only is None else f"CASE WHEN {only} THEN {path}.c + {cost} ELSE 1000000000 END"
    return f"{{'c': {c}, 'a': {path}.a || '{edit}', 't': {text}}}"


def _step_sql() -> str:
    """The best path to each state behind one more row, before inserts."""
    gone = [_then(f"d.s{k}", "2", "D") for k in range(4)]
    kept = lambda k, i: _then(f"d.s{k}", "r.more", "K", "r.role || ':' || r.text", f"r.stays AND r.i = '{i}'")
    named = lambda k, role: _then(f"d.s{k}", "r.more + 1", "R", f"'{role}:' || r.text", "r.stays")
    user = [f(k, x) for k in (0, 1, 3) for f, x in ((kept, "u"), (named, "user"))]
    return f"{gone[0]} AS s0, {_least(gone[1], kept(0, 's'))} AS s1, {_least(gone[2], *user)} AS s2, {_least(gone[3], kept(2, 'a'), named(2, 'assistant'))} AS s3"


def _inserted_sql(table: str) -> str:
    put = lambda k, role: _then(f"s{k}", "5", "I", f"'{role}:'")
    once = f"SELECT * REPLACE ({_least('s2', *(put(k, 'user') for k in (0, 1, 3)))} AS s2, {_least('s3', put(2, 'assistant'))} AS s3) FROM {table}"
    return f"SELECT * REPLACE ({_least('s2', put(3, 'user'))} AS s2, {_least('s3', put(2, 'assistant'))} AS s3) FROM ({once})"


_NO_PATH = "{'c': 1000000000, 'a': '', 't': ''}"

#: What report(repaired(damaged(conversations))) gives, by dynamic programming over whole paths.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [ascii(c) for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS k FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, k), lambda x, b: xor(x // 256, t[(xor(x, b) & 255) + 1])), 4294967295) % {KINDS} AS kind
  FROM keyed, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = {ROLE} THEN 'user' ELSE role END AS role,
    CASE kind WHEN {EMPTIED} THEN '' WHEN {CUT} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN {DROPPED} THEN 0 WHEN {REPEATED} THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
ordered AS (
  SELECT *, substr(role, 1, 1) AS i, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lag(substr(role, 1, 1)) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS solid
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ordered),
rows AS (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM faults),
paths AS (
  SELECT * FROM ({_inserted_sql(f"(SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NO_PATH} AS s1, {_NO_PATH} AS s2, {_NO_PATH} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations))")})
  UNION ALL
  SELECT * FROM ({_inserted_sql(f"(SELECT d.conv_id, r.n, {_step_sql()} FROM paths d JOIN rows r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n + 1)")})),
best AS (SELECT conv_id, {_least('s0', 's3')} AS b FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(b.b.t) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
