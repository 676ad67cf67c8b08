"""SentencePiece BPE encoding and decoding by the last token of every prefix.

Each prefix of a normalised text has one encoding, and so one last piece. The pieces that
end at a position come from an Aho-Corasick automaton over the vocabulary. Piece t is the
last one of the prefix that ends there if it is compatible with the last piece s of the prefix
that ends where t begins, that is, if merging the characters of s + t gives [s, t] again:
a BPE encoding is right exactly if all its neighbours are. From a table of last pieces
the ids are read off backwards.

Texts are cut where no piece spans the neighbouring characters, so a cut never changes
an encoding; the ids of parts (mostly words) are kept in two generations of CACHE each:
a full one becomes the old one, and what is used again moves to the new one.

The model's own parameters are read from its file: pieces, scores, types and the
normaliser's flags. Supported are BPE models with identity normalisation and byte fallback;
others are refused.

Nulls and ties: a null text is an empty one, which has the end id only. Texts of any length
are encoded whole. Rows may repeat; ids may be null. Columns besides the text may have any names; kept ones must not have those of
the result. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import hold, map_rows, with_fields

SPACE, NEVER = "▁", float("-inf")
#: Parts of a generation, and pairs of pieces, that a worker keeps. An entry takes some 200 bytes.
CACHE, FITS = 120_000, 50_000
#: Characters whose parts are looked at at once.
BLOCK = 1 << 16
#: Fixed values of the model format: types of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model. Inside, a space stands for the space mark, which normalisation makes of it anyway."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kinds & {USER, UNUSED}:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.kind = [p.type for p in proto.pieces]
        self.pieces = [p.piece if p.type != NORMAL else p.piece.replace(SPACE, " ") for p in proto.pieces]
        normal = [i for i, k in enumerate(self.kind) if k == NORMAL]
        self.score = {self.pieces[i]: proto.pieces[i].score for i in normal}
        self.ids = {self.pieces[i]: i for i in normal}
        self.said = [f" {i}" for i in range(len(self.pieces))]
        self.plain = [p if k == NORMAL else None for p, k in zip(self.pieces, self.kind, strict=True)]
        self.byte_id = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == "</s>")
        self.steps = lru_cache(len(self.pieces))(self._steps)
        self.fits = lru_cache(FITS)(self._fits)
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if any(whole == p for _, whole, _ in self._steps(p)):  # others are no result of merges
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(p[0] != " " and p[1] == " " for p in inside):
            raise ValueError("a piece goes on after a space mark that isn't at its front")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in inside))
        marks = "".join(c for c in ".,;:!?%$&#" if not any(p[0].isalnum() and p[1] == c for p in inside))
        rest = f"[^ {alone}{marks}]*" + f"(?:(?<![^\\W_])[{marks}][^ {alone}{marks}]*)*" * bool(marks)  # a mark behind a letter or digit starts a part
        self.cuts = re.compile(f" +{rest}|[^ {alone}]{rest}" + f"|[{alone}]" * bool(alone))

    def _steps(self, text: str) -> list[tuple[float, str, str]]:
        """Merges by score, the leftmost first among equals: (score, first part, last part after it). An impossible one comes last."""
        parts, get, out = list(text), self.score.get, []
        near = [get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while near and (best := max(near)) > NEVER:
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(near):
                near[at] = get(parts[at] + parts[at + 1], NEVER)
            out.append((best, parts[0], parts[-1]))
        return [*out, (NEVER, "", "")]

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces gives the two pieces.

        Both merge by themselves, the better step first, until a merge across the border would be better than either's next step.
        """
        own, other, get = iter(self.steps(left)), iter(self.steps(right)), self.score.get
        (a, _, last), (b, first, _) = next(own), next(other)
        x, y = left[-1], right[0]
        while True:
            cross = get(x + y, NEVER)
            if cross > a and cross >= b:
                return False
            if a >= b:
                if a == NEVER:
                    return True
                x = last
                a, _, last = next(own)
            else:
                y = first
                b, first, _ = next(other)

    def last_pieces(self, part: str) -> list[str]:
        """The last piece of each prefix of a part, the shortest prefix first."""
        last, fits, done = list(part), self.fits, -1  # where no longer piece fits, the character itself
        for end, (piece, size) in self.automaton.iter(part):  # longer pieces come first
            if end != done and (end < size or fits(last[end - size], piece)):
                last[end] = piece
                done = end
        return last

    def _ids(self, part: str) -> list[int]:
        last, at, back, ids = self.last_pieces(part), len(part), [], self.ids
        while at:
            piece = last[at - 1]
            at -= len(piece)
            if piece in ids:
                back.append(ids[piece])
            else:
                back.extend([self.byte_id[b] for b in reversed(piece.encode())])
        back.reverse()
        return back

    def part(self, part: str) -> str:
        """Ids of a part that stands alone, as text; from two generations of CACHE parts each if it is there.

        With byte fallback and identity normalisation nothing is lost, so ids decode to their part; each new part is decoded to see that.
        """
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                ids = self._ids(part)
                if self.decode_pieces(ids) != part:
                    raise ValueError(f"ids don't decode to their text: {part!r}")
                found = "".join([self.said[i] for i in ids])
            if len(part) <= 64:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[part] = found
        return found

    def parts(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, those of some BLOCK characters at a time."""
        text = text.replace(SPACE, " ")
        if text and self.dummy_prefix:
            text = " " + text
        at, size = 0, BLOCK
        while at < len(text):
            found = self.cuts.findall(text, at, at + size)
            if at + size < len(text):
                found.pop()  # it may go on
                size = BLOCK if found else 2 * size
                at += sum(map(len, found))
            else:
                at = len(text)
            yield found

    def coded(self, text: str) -> tuple[str, str]:
        """Ids as text, a space before each and without an end id, and what they decode to."""
        ids, decoded, part = [], [], self.part
        for parts in self.parts(text):
            found = list(map(self.young.get, parts))
            if None in found:
                found = [part(p) if f is None else f for p, f in zip(parts, found, strict=True)]
            ids.append("".join(found))
            decoded.append("".join(parts))  # as part() has found
        whole = "".join(decoded)
        return "".join(ids), whole[1:] if whole and self.dummy_prefix else whole

    def encode(self, text: str) -> list[int]:
        """Ids without an end id."""
        return [int(i) for i in self.coded(text)[0].split()]

    def decode_pieces(self, ids: list[int] | tuple[int, ...]) -> str:
        """The text of ids, its first space included. Bytes that are no UTF-8 become U+FFFD, one each."""
        found = [self.plain[i] for i in ids]
        if None not in found:
            return "".join(found)
        raw, out = bytearray(), []
        for i in [*ids, -1]:
            if i >= 0 and self.kind[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_bytes_text(bytes(raw)))
                raw.clear()
            if i >= 0 and self.kind[i] != CONTROL:
                out.append(" \u2047 " if self.kind[i] == UNKNOWN else self.pieces[i])
        return "".join(out)

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """As the library decodes: the space of the dummy prefix goes."""
        text = self.decode_pieces(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        starts = first is not None and self.kind[first] == NORMAL and self.pieces[first].startswith(" ")
        return text[1:] if starts and self.dummy_prefix else text


def _bytes_text(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            n = 1
        at += n
    return "".join(out)


def load(path: str) -> Pieces:
    """One model per worker process, so that its caches outlive a task."""
    return hold(("pieces", path), lambda: Pieces(path))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(docs: DataFrame, keep: list[str], text: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; an end id comes last."""
    path = model or default_model()

    def make():
        pieces = load(path)

        def step(batch):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for value in batch.column(text):
                ids, decoded = pieces.coded(value.as_py() or "")
                ids = f"{ids} {pieces.end_id}"[1:]
                out["n_tokens"].append(ids.count(" ") + 1)
                out["ids_sha256"].append(_hex(ids))
                out["decoded_sha256"].append(_hex(decoded))
                if with_ids:
                    out["ids"].append(np.fromstring(ids, np.int32, sep=" "))
            return out

        return step

    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_rows(docs.select(*dict.fromkeys([*keep, text])), with_fields(docs, keep, extra), make)
