"""Chat formatting: records of several layouts become canonical turns and one marked text.

The layout of a JSON record is told by its schema fingerprint: the SHA-256 of its sorted
nested field paths, arrays as ``[]``. A fingerprint selects a declarative mapping: for a
list of messages the path of the list and the names of its role and text fields, for flat
records a list of (role, path) in order. A mapping names paths that a record must have, those that it may have, and fields that
are left aside wherever they stand, which don't enter the fingerprint. A record whose fingerprint no mapping has is
returned with ``error`` set and no turns; it is never guessed at.

Template: a turn is ``<s>role\\ntext</s>``. In roles and texts a backslash is doubled, and
each control string gets a backslash behind its first character, so none occurs in a text and
removing the backslashes gives back what was there. The loss mask holds the (start, end) of
each assistant text in the formatted string, in code points.

Nulls and ties: a null text or role is an empty string, and an optional turn that is missing is left out; numbers and truth values
are written as JSON writes them. Rows of one conversation are ordered by turn (null first), then role and text; a null conv_id is a
conversation of its own. A conversation of any length is one row, and so must fit a task. Columns besides
the kept ones may have any names; kept ones must not have those of the result. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, with_fields

#: Control strings of common templates (fixed values); the first two are this template's marks.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + ".{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


#: Fields that say nothing about turns.
ASIDE = frozenset({"id", "source", "lang", "category", "score", "meta"})


def without_aside(value):
    """A record without the fields of ASIDE, at any depth."""
    if isinstance(value, dict):
        return {k: without_aside(v) for k, v in value.items() if k not in ASIDE}
    return [without_aside(v) for v in value] if isinstance(value, list) else value


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


#: Declarative mappings of known layouts: their field paths, those that may be missing, and where roles and texts are.
MAPPINGS: tuple[dict, ...] = (
    {"paths": {".messages[].role", ".messages[].content"}, "list": "messages", "role": "role", "text": "content"},
    {"paths": {".messages[]"}, "list": "messages", "role": "role", "text": "content"},
    {"paths": {".conversations[].from", ".conversations[].value"}, "list": "conversations", "role": "from", "text": "value"},
    {"paths": {".prompt", ".response"}, "maybe": {".system"}, "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"paths": {".instruction", ".output"}, "turns": [("user", "instruction"), ("assistant", "output")]},
    {"paths": {".instruction", ".input", ".output"}, "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": {".data.instruction", ".data.output"}, "turns": [("user", "data.instruction"), ("assistant", "data.output")]},
)


def registry(mappings: Sequence[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by the fingerprints of their layouts, with and without each optional path."""
    out = {}
    for m in mappings:
        maybe = sorted(m.get("maybe", ()))
        for n in range(len(maybe) + 1):
            out |= {fingerprint({*m["paths"], *some}): m for some in itertools.combinations(maybe, n)}
    return out


def said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    if "list" in mapping:
        return [(said(_at(m, mapping["role"])), said(_at(m, mapping["text"]))) for m in _at(record, mapping["list"])]
    return [(role, said(_at(record, path))) for role, path in mapping["turns"] if f".{path}" not in mapping.get("maybe", ()) or path in record]


def formatted(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"<s>{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), mask


_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def masked(text: str, mask: Sequence[tuple[int, int]]) -> list[str]:
    return [unescape(text[a:b]) for a, b in mask]


def format_records(records: DataFrame, keep: list[str], record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """keep, layout (fingerprint), formatted, loss_mask array<struct<start,end>>, error."""

    def make():
        known = registry(mappings)

        def step(batch):
            out = {"layout": [], "formatted": [], "loss_mask": [], "error": []}
            for value in batch.column(record):
                layout = text = mask = error = None
                try:
                    found = without_aside(json.loads(value.as_py() or ""))
                    layout = fingerprint(field_paths(found))
                    text, mask = formatted(canonical(found, known[layout]))
                except ValueError:
                    error = "not JSON"
                except KeyError:
                    error = "unknown layout"
                out["layout"].append(layout)
                out["formatted"].append(text)
                out["loss_mask"].append(None if mask is None else [{"start": a, "end": b} for a, b in mask])
                out["error"].append(error)
            return out

        return step

    extra = "layout string, formatted string, loss_mask array<struct<start:long,end:long>>, error string"
    return map_rows(records.select(*keep, record), with_fields(records, keep, extra), make)


def read_back(chats: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted and loss_mask alone."""

    def make():
        def step(batch):
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns, loss = parsed(text or ""), "".join(masked(text or "", [(m["start"], m["end"]) for m in mask or []]))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text or "")))
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return step

    extra = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_rows(chats, with_fields(chats, keep, extra), make)


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: rows (conv_id, turn, role, text) as JSON in the layout that suits them.

    A user and an assistant turn make a prompt and a response; a system, a user and an
    assistant turn an instruction, an input and an output; all else is a list of messages.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), "\n")
    text = lambda i: F.get("turns", F.lit(i))["content"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    triple = F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")))
    messages = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    record = F.when((roles == "user\nassistant") & (F.size("turns") == 2), pair).when((roles == "system\nuser\nassistant") & (F.size("turns") == 3), triple)
    return grouped.select("conv_id", record.otherwise(messages).alias("record"))
