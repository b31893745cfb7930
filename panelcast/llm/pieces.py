"""Subword pieces: encoding by a streaming Viterbi over a bounded window, and decoding.

The vocabulary is that of a merge-based model. A sequence of pieces is its encoding exactly if each piece and
each two neighbours encode to themselves, so the lattice keeps, for every place, the one piece that can end
there after its predecessor. That makes the best path the same as merging would give, without merging the text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelcast.llm.common import send_code, strings

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and neighbour pairs, that a Python worker remembers in each of two generations; the older one is
#: forgotten when the younger is full.
REMEMBERED = 500_000
#: Documents encoded before their ids are handed over.
AT_A_TIME = 500
#: Signs that are looked up at once.
HEAD = 4
#: A score below all others.
NEVER = float("-inf")
#: Texts that normalizers change: wide and joined letters, accents apart, spaces in front, behind and in a row.
PROBES = ("The rain in Spain", "  two  spaces ", "ﬁ Ａ ① e\u0301", "a\n\tb", "日本語 😀")
#: Places after which a long run of text is tested for a boundary that all paths share.
COMMIT_EVERY = 64


class Pieces:
    """Pieces with their ranks. ``pieces`` lists (piece, id, score); ``byte_ids`` the ids of the 256 bytes."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        self.entries = pieces
        self.rank = {p: s for p, _, s in pieces}
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.rank), default=1)
        # Two signs that stand together in no piece are never merged: every path has a boundary between them.
        self.beside = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.crossing = any(b[1] == SPACE != b[0] for b in self.beside)
        self.size = max([*(i for _, i, _ in pieces), *byte_ids]) + 1
        self.names = [""] * self.size
        self.texts = [b""] * self.size
        self.steps: list[list[tuple[float, str, str]]] = [[]] * self.size
        self.trie: dict[str, list] = {}  # sign -> [id of the piece that ends here or -1, what follows]
        for p, i, _ in pieces:
            self.names[i] = p
            self.texts[i] = p.replace(SPACE, " ").encode()
            parts, self.steps[i] = self.merged(p)
            if parts == [p]:
                node = self.trie
                for sign in p[:-1]:
                    node = node.setdefault(sign, [-1, {}])[1]
                node.setdefault(p[-1], [-1, {}])[0] = i
        for value, i in enumerate(byte_ids):
            self.texts[i] = bytes([value])
        self.remembered = REMEMBERED
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[int, dict[int, bool]] = {}
        self.rows = 0
        self.heads: dict[str, tuple] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """A short text merged pair by pair, best score first, leftmost on ties: the parts left, and after each step
        its score and the first and last part."""
        parts, steps = list(text), []
        while len(parts) > 1:
            scores = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _head(self, text: str) -> tuple:
        """The pieces at the start of a few signs, as (length, id), and where the trie goes on; remembered."""
        if len(self.heads) > REMEMBERED:
            self.heads.clear()
        out, node = [], self.trie
        for place, sign in enumerate(text, 1):
            found = node.get(sign)
            if found is None:
                node = None
                break
            piece, node = found
            if piece >= 0:
                out.append((place, piece))
        self.heads[text] = made = tuple(out), node if node and len(text) == HEAD else None
        return made

    def _row(self, one: int) -> dict[int, bool]:
        """What is remembered of pieces after ``one``; all is forgotten when it grows too large."""
        if self.rows > REMEMBERED:
            self.fits.clear()
            self.rows = 0
        return self.fits.setdefault(one, {})

    def fit(self, one: int, other: int) -> bool:
        """Whether the piece ``other`` can follow the piece ``one``: merging both side by side, no step of the two
        comes after a merge across the boundary between them."""
        self.rows += 1
        left, right, rank = self.steps[one], self.steps[other], self.rank
        last, first = self.names[one][-1], self.names[other][0]
        i = j = 0
        while True:
            a, b = left[i][0] if i < len(left) else NEVER, right[j][0] if j < len(right) else NEVER
            across = rank.get(last + first, NEVER)
            if across > a and across >= b:
                return False
            if a == NEVER and b == NEVER:
                return True
            if a >= b:
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1

    def path(self, text: str) -> array:
        """The ids of ``text``, a stretch of signs, by a Viterbi pass.

        The lattice keeps, for each of the places that a piece from here can reach, the one piece that ends there
        after its predecessor (-1: none yet, -2: a sign without a piece, which fits everywhere), and the part of
        the path not yet committed: everything before the last boundary that all surviving paths share is
        handed out and forgotten, so no more than a window is held of a text of any length."""
        fits, heads, width, size = self.fits, self.heads, self.size, len(text)
        out, done = array("i"), 0
        window = min(size, COMMIT_EVERY + self.longest) + 1
        last, length = [-2] + [-1] * (window - 1), [0] * window  # of the places from ``done`` on
        for start in range(size):
            here = start - done
            before, head = last[here], text[start:start + HEAD]
            found = heads.get(head)
            if found is None:
                found = self._head(head)
            pieces, node = found
            row = fits[before] if before in fits else self._row(before)
            for place, piece in pieces:
                if last[here + place] == -1:
                    fine = row.get(piece)
                    if fine is None:
                        fine = row[piece] = before < 0 or self.fit(before, piece)
                    if fine:
                        last[here + place], length[here + place] = piece, place
            if node is not None:
                place = HEAD
                for sign in text[start + HEAD:start + self.longest]:
                    found = node.get(sign)
                    if found is None:
                        break
                    place += 1
                    piece, node = found
                    if piece >= 0 and last[here + place] == -1 and (before < 0 or self.fit(before, piece)):
                        last[here + place], length[here + place] = piece, place
            if last[here + 1] == -1 and not (pieces and pieces[0][0] == 1):
                last[here + 1], length[here + 1] = -2, 1
            if here + 1 >= COMMIT_EVERY and start + 1 < size:
                shared = self._shared(last, length, here + 1)
                if shared:
                    self._commit(text, done, last, length, shared, out)
                    del last[:shared], length[:shared]
                    done += shared
                more = min(size - done, here + 1 + COMMIT_EVERY + self.longest) + 1 - len(last)
                last += [-1] * more
                length += [0] * more
        self._commit(text, done, last, length, size - done, out)
        return out

    @staticmethod
    def _shared(last: list[int], length: list[int], now: int) -> int:
        """The last boundary that the paths to this place and to all places reached beyond run through."""
        live = {i for i in range(now, len(last)) if last[i] != -1}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - length[far])
        return live.pop()

    def _commit(self, text: str, done: int, last: list[int], length: list[int], end: int, out: array) -> None:
        """Hand out the ids of the path to place ``end``."""
        ids: list[int] = []
        while end > 0:
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids += [self.byte_ids[b] for b in reversed(text[done + end - 1].encode("utf-8", "replace"))]
            end -= length[end]
        out.extend(ids[::-1])

    def _remembered(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= self.remembered:
                self.older, self.known = self.known, {}
            self.known[text] = ids
        return ids

    def _part(self, text: str) -> bytes:
        return self.known.get(text) or self._remembered(text, self.older.get(text) or self.path(text).tobytes())

    def _word(self, word: str) -> bytes:
        """The ids of a word, cut where two signs are never merged; its parts are remembered too."""
        old = self.older.get(word)
        if old is None:
            cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.beside]
            if not cuts:
                return self._part(word)
            parts = [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]
            old = b"".join([self._part(p) for p in parts])
        return self._remembered(word, old)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text: spaces become space marks and one is put in front. Null and empty texts have none."""
        if not text:
            return np.zeros(0, "i4")
        text = SPACE + text.replace(" ", SPACE)
        # Cut before a space mark that no piece has after another sign; without such pieces, before all of them.
        words = [text] if self.crossing else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        get, word = self.known.get, self._word
        return np.frombuffer(b"".join([get(w) or word(w) for w in words]), "i4")

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the space put in front; broken bytes become U+FFFD."""
        texts = self.texts
        return b"".join([texts[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def load(path: str = MODEL) -> Pieces:
    """The pieces of a model file; control, unknown and unused entries never occur in an encoding.

    A model that is not merge-based, or that changes texts before it encodes them, is an error: its scores are no
    ranks, or its ids of PROBES are not those of the pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [(model.id_to_piece(i), i) for i in range(model.get_piece_size())]
    plain = [(p, i, model.get_score(i)) for p, i in entries
             if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    made = Pieces(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if any(s != int(s) for _, _, s in plain) or any(made.encode(x).tolist() != model.encode(x) for x in PROBES):
        raise ValueError(f"{path} is not a merge-based model without a normalizer")
    return made


def encoded(
    docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """``key`` of every row of ``docs``, the ids of its whole text, and whether decoding them gives the text back
    (with each space mark in it as a space, as the vocabulary can't tell them apart): key, n_ids, ids, decoded_ok.

    Null and empty texts have no ids and decode to the empty text. Rows never meet one another; few at a time
    are held as ids, so that long texts need no more memory than they must."""
    send_code(__name__)
    names = [key, "n_ids", "ids", "decoded_ok"]
    # A vocabulary is small. A worker keeps what is broadcast from task to task, and so what it has remembered.
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces.entries, "byte_ids": pieces.byte_ids})

    def encode(frames):
        held = shared.value
        if "model" not in held:
            held["model"] = Pieces(held["pieces"], held["byte_ids"])
            held["model"].remembered = remembered
        model = held["model"]
        for frame in frames:
            for at in range(0, len(frame), AT_A_TIME):
                part = frame.iloc[at:at + AT_A_TIME]
                rows = []
                for k, x in zip(part[key].to_numpy(object), strings(part[text]), strict=True):
                    ids = model.encode(x)
                    same = model.decode(ids.tolist()) == (x or "").replace(SPACE, " ")
                    rows.append((None if k is None or k != k else k, len(ids), ids, same))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(encode, f"`{key}` {kind}, n_ids long, ids array<int>, decoded_ok boolean")
