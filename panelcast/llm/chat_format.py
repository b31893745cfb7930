"""Chat formatting: a visitor flattens typed content parts into one text with ordered placeholders.

A turn is ``<|turn|>role``, a line feed, its parts in order, ``<|end|>`` and a line feed. Text parts stand as they are,
but for control strings, which get a backslash behind their first sign; every other part is a placeholder whose
reference, place and expanded number of tokens are recorded. A loss mask covers the texts of learned roles.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import by_number, by_text, materialized, send_code, strings

# Marks of turns and placeholders, and control strings of common templates. None may begin inside of
# another or hold a backslash.
TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CONTROLS = (TURN, END, *PLACEHOLDERS.values(), OTHER, *FOREIGN)

#: Roles whose texts are learned.
LEARNED = frozenset({"assistant"})
#: A longer conversation is given in several rows, each of whole turns.
PIECE_CHARS = 1_000_000

PARTS = "array<struct<kind string, text string, ref string, width int, height int, seconds double, pages int>>"
PIECE_COLUMNS = ["conv_id", "piece", "formatted", "n_turns", "spans", "attachments"]
PIECES = ("conv_id string, piece long, formatted string, n_turns long, spans array<struct<start long, end long>>, "
          "attachments array<struct<kind string, ref string, at long, tokens long>>")

_ESCAPABLE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))
_MARKS = re.compile("(" + "|".join(re.escape(c) for c in (*PLACEHOLDERS.values(), OTHER)) + ")")


def escaped(text: str) -> str:
    """``text`` with one backslash more behind the first sign of each control string, also of those that have some."""
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder stands for. What is not known counts once; no part counts less than one."""

    patch: int = 28  # pixels of an image patch's side
    audio: float = 25.0  # tokens a second
    page: int = 600  # tokens a page

    def image(self, part: dict) -> int:
        return math.ceil((part.get("width") or 1) / self.patch) * math.ceil((part.get("height") or 1) / self.patch)

    def seconds(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0) * self.audio)

    def pages(self, part: dict) -> int:
        return (part.get("pages") or 1) * self.page


class Flattener:
    """Visits the parts of turns and writes them one after the other."""

    def __init__(self, costs: Costs = Costs(), learned: frozenset[str] = LEARNED):
        self.costs, self.learned = costs, learned
        self.out, self.at, self.turns, self.spans, self.attachments = [], 0, 0, [], []

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, text: str, learned: bool) -> None:
        start = self.at
        self._put(escaped(text))
        if learned and self.at > start:
            self.spans.append({"start": start, "end": self.at})

    def _placeholder(self, part: dict, tokens: int) -> None:
        kind = part.get("kind")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": max(1, tokens)})
        self._put(PLACEHOLDERS.get(kind, OTHER))

    def visit_image(self, part: dict) -> None:
        self._placeholder(part, self.costs.image(part))

    def visit_audio(self, part: dict) -> None:
        self._placeholder(part, self.costs.seconds(part))

    def visit_document(self, part: dict) -> None:
        self._placeholder(part, self.costs.pages(part))

    def visit_other(self, part: dict) -> None:
        self._placeholder(part, 1)

    def turn(self, role: str, parts: list[dict]) -> None:
        """One turn. Neighbouring text parts are one text, lest a control string come about between them."""
        self._put(TURN + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n")
        texts = []
        for part in [*parts, None]:
            if part is not None and part.get("kind") == "text":
                texts.append(part.get("text") or "")
                continue
            if texts:
                self.visit_text("".join(texts), role in self.learned)
                texts = []
            if part is not None:
                getattr(self, f"visit_{part.get('kind')}" if part.get("kind") in PLACEHOLDERS else "visit_other")(part)
        self._put(END + "\n")
        self.turns += 1

    @property
    def formatted(self) -> str:
        return "".join(self.out)


def read(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of every turn; parts are ("text", text) or (kind of placeholder, its mark)."""
    kinds = {mark: kind for kind, mark in PLACEHOLDERS.items()} | {OTHER: "other"}
    for turn in formatted.split(TURN)[1:]:
        head, body = turn.split("\n", 1)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(head))
        parts = _MARKS.split(body[: -len(END) - 1])
        yield role, [(kinds.get(p, "text"), p if p in kinds else unescaped(p)) for p in parts if p]


def formatted(conversations: DataFrame, parts: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """Rows PIECES, conv_id a bigint, of ``conversations`` (conv_id, turn, role, text): the conversations in order of their ids, each in
    one row, or in several rows of whole turns if it is longer than PIECE_CHARS or lies in several partitions.
    ``piece`` rises with the order. ``spans`` (code points of ``formatted``) is the loss mask; ``at`` of an
    attachment is where its placeholder begins.

    ``parts`` may name a column of type PARTS; where it is not null, it stands in place of ``text``. Null parts are
    left out, unknown and null kinds get a common placeholder. Null roles and texts count as empty. Turns that
    repeat are all kept; equal turns are ordered by role, then text; null turns come first. Rows without a conv_id
    are one conversation without an id. An empty table gives no rows; other columns are left out.

    Rows are dealt by ranges of (conv_id, turn, role), so that even one huge conversation is formatted by many
    tasks; a task holds one piece at a time."""
    send_code(__name__)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col(parts) if parts else F.lit(None)).cast(PARTS).alias("parts"))
    rows = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")

    def flattened(frames):
        number, flat, now = TaskContext.get().partitionId() << 33, None, None

        def done():
            return (now, number, flat.formatted, flat.turns, flat.spans, flat.attachments)

        for frame in frames:
            out = []
            ids = strings(frame["conv_id"])
            for conv, role, text, own in zip(ids, frame["role"], frame["text"], frame["parts"], strict=True):
                if flat is not None and (conv != now or flat.at >= PIECE_CHARS):
                    out.append(done())
                    flat, number = None, number + 1
                if flat is None:
                    flat, now = Flattener(costs), conv
                kept = [{"kind": "text", "text": text}] if own is None else [p for p in own if p is not None]
                flat.turn(role, kept)
            if out:
                yield pd.DataFrame(out, columns=PIECE_COLUMNS)
        if flat is not None:
            yield pd.DataFrame([done()], columns=PIECE_COLUMNS)

    return by_number(by_text(rows, "conv_id").mapInPandas(flattened, PIECES), "conv_id")


class Digest:
    """What is read back from the pieces of one conversation, in their order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans) -> Digest:
        for role, parts in read(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{''.join(p for _, p in parts)}\n".encode())
        for span in spans:
            learned = unescaped(text[span["start"]:span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(text)
        return self

    def row(self, conv):
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGESTS = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")
_OPEN = "piece long, formatted string, spans array<struct<start long, end long>>"


def digests(pieces: DataFrame) -> DataFrame:
    """Rows DIGESTS, conv_id a bigint, one per conversation, read back from ``pieces`` as ``formatted`` gives them, in that order.

    A conversation of one piece that neither begins nor ends its partition is whole and is digested on the spot;
    the pieces of all others go, by conversation, to a task that hashes them one after the other and holds one."""
    send_code(__name__)
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def whole(frames):
        first, held, alone = True, None, True  # the last piece seen, and whether it is all of its conversation

        def settled(last):
            if alone and not last:
                return (*Digest().add(held[2], held[3]).row(held[0]), None, None, None)
            return (held[0], None, None, None, None, None, *held[1:])

        for frame in frames:
            out = []
            ids = strings(frame["conv_id"])
            for piece in zip(ids, frame["piece"], frame["formatted"], frame["spans"], strict=True):
                if held is None:
                    alone = not first
                elif piece[0] != held[0]:
                    out.append(settled(False))
                    alone = True
                else:
                    alone = False
                    out.append(settled(False))
                held, first = piece, False
            yield pd.DataFrame(out, columns=[*names, "piece", "formatted", "spans"]).astype(
                {c: "Int64" for c in ("n_turns", "loss_chars", "formatted_chars", "piece")})
        if held is not None:
            yield pd.DataFrame([settled(True)], columns=[*names, "piece", "formatted", "spans"])

    def joined(frames):
        now, digest = None, None
        for frame in frames:
            out = []
            ids = strings(frame["conv_id"])
            for conv, text, spans in zip(ids, frame["formatted"], frame["spans"], strict=True):
                if digest is not None and conv != now:
                    out.append(digest.row(now))
                    digest = None
                digest, now = (digest or Digest()).add(text, spans), conv
            yield pd.DataFrame(out, columns=names)
        if digest is not None:
            yield pd.DataFrame([digest.row(now)], columns=names)

    rows = materialized(by_text(pieces, "conv_id").select("conv_id", "piece", "formatted", "spans").mapInPandas(
        whole, f"{DIGESTS}, {_OPEN}"), "chat")
    parted = rows.where("piece is not null").select("conv_id", "piece", "formatted", "spans")
    parted = parted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    every = rows.where("piece is null").select(*names).unionByName(parted.mapInPandas(joined, DIGESTS))
    return by_number(every, "conv_id")
