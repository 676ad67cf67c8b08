import hashlib
import itertools
import random
import time
import zlib

import pytest

from marginalia.llm import repair
from marginalia.llm.queries import op12_repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, cost string, kind string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def all_edits(rows):
    """(cost, audit) of the best of all edits, two inserts in a row at most, by trying every one."""
    best = (10**9, "")

    def go(i, state, cost, audit, inserts):
        nonlocal best
        if i == len(rows) and state in (0, 3):
            best = min(best, (cost, audit))
        if cost > best[0]:
            return
        if inserts < 2:
            go(i, NEXT[state], cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 2, audit + "D", 0)
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                if (initial, state) in KEPT:
                    go(i + 1, KEPT[initial, state], cost + more, audit + "K", 0)
                go(i + 1, NEXT[state], cost + 1 + more, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def whole_paths(rows):
    """The same by dynamic programming that keeps every path as text."""
    best = {0: (0, "")}

    def inserted():
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                best[NEXT[s]] = min(best.get(NEXT[s], (10**9, "")), (c + 5, a + "I"))

    inserted()
    for initial, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            offers = [(s, c + 2, a + "D")]
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                offers += [(KEPT[initial, s], c + more, a + "K")] if (initial, s) in KEPT else []
                offers.append((NEXT[s], c + 1 + more, a + "R"))
            for to, cost, audit in offers:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        best.clear()
        best.update(new)
        inserted()
    return min(best[s] for s in (0, 3) if s in best)


def decoded(rows):
    d = repair.Decoder()
    out = [x for r in rows for x in d.step(*r)]
    return "".join(e * n for e, n in out + d.end())


FAULTS = [None, "truncated", "blank"]


@pytest.mark.parametrize("n", range(4))
def test_decoder_equals_all_edits(n):
    for rows in itertools.product(itertools.product("sua", FAULTS), repeat=n):
        assert decoded(rows) == all_edits(rows)[1] == whole_paths(rows)[1]


def test_decoder_equals_whole_paths():
    rng = random.Random(5)
    for _ in range(2000):
        n, initials = rng.choice([5, 9, 30]), rng.choice(["uuaa", "suax "])
        rows = [(rng.choice(initials), rng.choice([None, None, *FAULTS])) for _ in range(n)]
        assert decoded(rows) == whole_paths(rows)[1]


def tree_size(d):
    seen, todo = 0, [d.root]
    while todo:
        seen += 1
        todo += todo.pop().kids
    return seen


def test_memory_is_bounded_by_the_undecided_stretch():
    d = repair.Decoder()
    chat = [("u", None), ("a", None), ("u", "truncated"), ("a", "blank")] * 500
    assert max(d.step(*r) is None or tree_size(d) for r in chat) < 30
    d = repair.Decoder()
    d.step("u", None)
    for _ in range(2000):  # undecided all the time, but deletions are one node a branch
        assert d.step("u", "blank") == [] and tree_size(d) < 10


def test_undecided_stretches_take_time_in_proportion():
    def took(n):
        began = time.process_time()
        assert decoded([("u", None)] * n) == "KR" * (n // 2)
        return time.process_time() - began

    took(100)
    assert took(20_000) < 40 * took(2_000)


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


WHITE = " \t\n\x0b\x0c\r"


def plain_report(rows):
    out = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        out[r[0]].append(r)
    for conv, own in out.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, steps = set(), []
        for _, _, role, text in own:
            solid = text.strip(WHITE)
            steps.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit = whole_paths(steps)
        lines, state, at = [], 0, 0
        for edit in audit:
            if edit != "D":
                state = KEPT[steps[at][0], state] if edit == "K" else NEXT[state]
                role = own[at][2] if edit == "K" else {2: "user", 3: "assistant"}[state]
                lines.append(f"{role}:{'' if edit == 'I' else own[at][3]}")
            at += edit != "I"
        turns = [t for _, t, _, _ in own if t is not None]
        faults = [f for _, f in steps]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(steps))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def report_of(spark, rows):
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.report(repair.repaired(repair.damaged(table))).collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_repair(spark, sf_dir).collect()), key=repr) == sorted(plain_report(rows), key=repr)


def test_odd_rows(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No", None, "", " \t", "Why? ", "Ünï!\n", "x" * 50_000 + ".", "a\x85", "Yes."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [(rng.choice([1, 2, 3, 4, None, -1]), rng.choice([0, 1, 2, 3, 9, None]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(100 + c, t, rng.choice(roles[:3]), rng.choice(texts)) for c in range(60) for t in range(rng.choice([1, 2, 6]))]
    rows += [(7, t, "user", "The same text.") for t in range(300)]  # one hot text
    assert report_of(spark, rows) == sorted(plain_report(rows), key=repr)


def test_every_conversation_is_returned(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report_of(spark, [(conv, 0, "user", "Hello.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert report_of(spark, []) == []


def test_edits(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Yes."), (1, 4, "user", "And"), (1, 5, "assistant", "So.")]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = [(r["edit"], r["role"], r["text"], r["turn"], r["fault"], r["cost"]) for r in repair.repaired(table).orderBy("place").collect()]
    assert all_edits([("a", None), ("u", None), ("u", "duplicate"), ("a", None), ("u", "truncated"), ("a", None)]) == (7, "RRDRDK")
    assert got == [("rerole", "user", "Hi.", 0, None, 1), ("rerole", "assistant", "Hello.", 1, None, 1), ("delete", None, None, 2, "duplicate", 2), ("rerole", "user", "Yes.", 3, None, 1), ("delete", None, None, 4, "truncated", 2), ("keep", "assistant", "So.", 5, None, 0)]


def test_partitions_of_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}.") for c in range(3) for t in range(40)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert report_of(spark, rows) == sorted(plain_report(rows), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
