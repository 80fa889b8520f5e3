"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

An encoding is the best path through the lattice of pieces that cover a text.
In a unigram model a piece weighs its score. In a BPE model a path weighs 0 if
every two neighbouring pieces are what BPE makes of their concatenation, and
minus infinity otherwise: a sequence is the BPE encoding of a text exactly if
all its neighbours agree in this way, so one path is left.

A giant document is cut into chunks anywhere, inside words too. The state at a
boundary is the piece that covers the character before it, given by where it
begins and ends; a chunk's transfer matrix holds the weight of the best way from
each state at its left boundary to each at its right one. Matrices combine by
the max-plus product, which is associative. Once the states on the best path are
known, every chunk finds its own pieces without the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions

BLANK = "▁"
NEVER = -math.inf
CHUNK = 16_384
FAN = 16  # matrices that one product takes
SHORT = 40  # characters of a word that is merged; longer ones walk the lattice, in time that grows with the length only
KEPT = 400_000  # words that a task remembers
LONGEST_KEPT = 64  # characters of a word that is remembered
UNJOINED = np.int32(2**31 - 1)  # rank of neighbours that make no piece
State = tuple[int, int]  # begin and end of a piece, relative to a boundary


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message: varints and byte strings, others skipped."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            at += 8 if kind == 1 else 4


class Lexicon(dict):
    """Numbers for the words met so far; their ids stand one after another in a flat array.

    A key is a word without the blank before it. One with several blanks before
    it is its own key, and one without any has a blank behind it as its mark.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.fresh: list[str] = []
        self.count = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def __missing__(self, key: str) -> int:
        own = self[key] = self.count
        self.count += 1
        self.fresh.append(key)
        return own

    def settle(self) -> None:
        """Encode all new words at once."""
        if not self.fresh:
            return
        ids, length = self.pieces.words_ids([k[:-1] if k[-1:] == BLANK and k[0] != BLANK else k if k[:1] == BLANK else BLANK + k for k in self.fresh])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        while self.count > len(self.start):
            self.start, self.length = np.concatenate([self.start] * 2), np.concatenate([self.length] * 2)
        first = self.count - len(self.fresh)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first : self.count] = self.used + np.cumsum(length) - length
        self.length[first : self.count] = length
        self.used += len(ids)
        for key in self.fresh:
            if len(key) > LONGEST_KEPT:
                del self[key]
        self.fresh = []

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of settled words one after another, and how many each word has."""
        length = self.length[numbers]
        begin = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[numbers] - begin, length) + np.arange(int(length.sum()))], length


@dataclass
class Pieces:
    """A model's pieces; ``agrees`` remembers which neighbours BPE leaves alone."""

    scores: dict[str, float]
    ids: dict[str, int]
    by_id: list[str]
    bytes_: dict[int, int]  # id of a byte piece: its byte
    unknown: int
    bpe: bool
    prefix: bool  # a blank is put before the text
    longest: int
    utf8: list[bytes]  # of each id
    symbols: np.ndarray  # of a character: its id, or len(by_id) plus the code point if it is no piece
    pairs: np.ndarray  # two symbols that make a piece, in order
    pair_rank: np.ndarray  # best first from 0; of pieces of one score the leftmost is merged first
    pair_piece: np.ndarray
    agreed: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lexicon = Lexicon(self)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read on the driver; 32,000 pieces take about a megabyte to broadcast."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            top = dict(x for x in _fields(file.read()) if x[0] != 1)
        trainer, normalizer = dict(_fields(top[2])), dict(_fields(top[3]))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that leave the text as it is are read")
        by_id = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(by_id)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls.of({by_id[i]: model.get_score(i) for i in plain}, by_id, {i: int(by_id[i][1:-1], 16) for i in range(len(by_id)) if model.is_byte(i)}, model.unk_id(), trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)))

    @classmethod
    def of(cls, scores: dict[str, float], by_id: list[str], bytes_: dict[int, int], unknown: int, bpe: bool, prefix: bool = True) -> Pieces:
        ids = {p: i for i, p in enumerate(by_id) if p in scores}
        utf8 = [bytes([bytes_[i]]) if i in bytes_ else p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(by_id)]
        symbols = np.arange(0x110000, dtype=np.int32) + np.int32(len(by_id))
        for p, i in ids.items():
            if len(p) == 1:
                symbols[ord(p)] = i
        level = {x: place for place, x in enumerate(sorted({scores[p] for p in ids}, reverse=True))}
        joined = sorted((ids[p[:n]] << 21 | ids[p[n:]], level[scores[p]], i) for p, i in ids.items() for n in range(1, len(p)) if p[:n] in ids and p[n:] in ids) if bpe else []
        pairs = np.array([k for k, _, _ in joined] or [-1], np.int64)
        ranks, made = np.array([r for _, r, _ in joined] or [UNJOINED], np.int32), np.array([i for _, _, i in joined] or [0], np.int32)
        return cls(scores, ids, by_id, bytes_, unknown, bpe, prefix, max(map(len, scores)), utf8, symbols, pairs, ranks, made)

    def plain(self) -> tuple:
        """What the pieces are rebuilt from in a task, none of it of a class of this package."""
        return tuple(getattr(self, f.name) for f in fields(self) if f.name != "agreed")

    # Text and pieces

    def normal(self, text: str) -> str:
        return (BLANK + text if self.prefix and text else text).replace(" ", BLANK)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """The id of a piece; a character that is none becomes its bytes, or the unknown id."""
        own = self.ids.get(piece)
        if own is not None:
            return (own,)
        if self.bytes_:
            first = min(self.bytes_)
            return tuple(first + b for b in piece.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def weight(self, piece: str) -> float:
        """Of a lattice edge; single characters outside the model are edges too, last choice in a unigram model."""
        own = self.scores.get(piece)
        if own is None:
            return NEVER if len(piece) > 1 else self._last if not self.bpe else 0.0
        return 0.0 if self.bpe else own

    @property
    def _last(self) -> float:
        return min(self.scores.values()) - 10.0

    def merged(self, text: str) -> list[str]:
        """BPE from characters: merge the best-scored neighbours, leftmost first, until none is a piece."""
        score = self.scores.get
        parts = list(text)
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the pieces may stand side by side; left is empty at the start of a text or word."""
        if not self.bpe:
            return True
        key = (left, right)
        own = self.agreed.get(key)
        if own is None:
            if len(self.agreed) > 2_000_000:
                self.agreed.clear()
            own = self.agreed[key] = self.merged(left + right) == ([left, right] if left else [right])
        return own

    # The lattice

    def walk(self, text: str, begin: int, at: int, stop: int) -> tuple[list[int], list[float]]:
        """Best paths from the node ``at`` (reached by text[begin:at]) to the nodes up to ``stop``.

        For each node: where the last piece of the best path begins (-1: unreached), and the weight.
        """
        back, best = [-1] * (stop - at + 1), [NEVER] * (stop - at + 1)
        back[0], best[0] = begin, 0.0
        scores, longest = self.scores, self.longest
        for j in range(at + 1, stop + 1):
            for i in range(max(at, j - longest), j):
                if best[i - at] == NEVER:
                    continue
                piece = text[i:j]
                if piece not in scores and j - i > 1:
                    continue
                total = best[i - at] + self.weight(piece)
                if total > best[j - at] and self.agree(text[back[i - at] : i], piece):
                    back[j - at], best[j - at] = i, total
                    if self.bpe:
                        break  # only one piece can be the last of a BPE encoding
        return back, best

    def trace(self, text: str, back: list[int], at: int, end: int) -> list[str]:
        out = []
        while end > at:
            begin = back[end - at]
            out.append(text[begin:end])
            end = begin
        return out[::-1]

    def word(self, text: str) -> list[int]:
        """Ids of a text between two places that no piece crosses, by walking the lattice."""
        pieces = self.trace(text, self.walk(text, 0, 0, len(text))[0], 0, len(text))
        return [x for piece in pieces for x in self.piece_ids(piece)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of neighbouring symbols, best first from 0, and where they stand in the table of pairs."""
        key = left.astype(np.int64) << 21 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.pair_rank[at], UNJOINED), at

    def merged_rows(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """BPE of words of one length, a row of symbols each: (rows, their symbols) as they are finished.

        Every round merges the leftmost best neighbours of each row, so all rows
        that are left have one symbol less.
        """
        row = np.arange(len(s))
        r, at = self.rank(s[:, :-1], s[:, 1:])
        while len(row) and s.shape[1] > 1:
            best = r.argmin(axis=1)
            here = np.arange(len(row))
            stuck = r[here, best] == UNJOINED
            if stuck.any():
                yield row[stuck], s[stuck]
                go = ~stuck
                row, s, r, at, best = row[go], s[go], r[go], at[go], best[go]
                here = here[: len(row)]
            joined = self.pair_piece[at[here, best]]
            column = np.arange(s.shape[1] - 1)
            s = np.take_along_axis(s, column + (column > best[:, None]), axis=1)
            s[here, best] = joined
            column = column[:-1] + (column[:-1] >= best[:, None])
            r, at = np.take_along_axis(r, column, axis=1), np.take_along_axis(at, column, axis=1)
            for rows, left in ((np.flatnonzero(best > 0), -1), (np.flatnonzero(best < s.shape[1] - 1), 0)):
                place = best[rows] + left
                r[rows, place], at[rows, place] = self.rank(s[rows, place], s[rows, place + 1])
        if len(row):
            yield row, s

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words one after another, and how many each has."""
        n_chars = np.array(list(map(len, words)))
        start = np.cumsum(n_chars) - n_chars
        found: list[tuple[np.ndarray, np.ndarray]] = []
        walked = n_chars > SHORT if self.bpe else np.ones(len(words), bool)
        if not walked.all():
            symbols = self.symbols[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
            for n in np.unique(n_chars[~walked]).tolist():
                rows = np.flatnonzero(n_chars == n)
                found += [(rows[own], s) for own, s in self.merged_rows(symbols[start[rows][:, None] + np.arange(n)])]
        found += [(np.array([i]), np.array([self.word(words[i])], np.int32)) for i in np.flatnonzero(walked)]
        length = np.zeros(len(words), np.int64)
        for rows, s in found:
            length[rows] = s.shape[1]
        begin = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.int32)
        for rows, s in found:
            flat[begin[rows][:, None] + np.arange(s.shape[1])] = s
        odd = np.flatnonzero(flat >= len(self.by_id))  # characters that are no piece
        if len(odd):
            codes, of = np.unique(flat[odd] - len(self.by_id), return_inverse=True)
            own = [self.piece_ids(chr(c)) for c in codes.tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = np.array([len(x) for x in own])[of]
            place = np.cumsum(times) - times
            word = np.repeat(np.arange(len(words)), length)
            flat, length = np.repeat(flat, times), np.bincount(word, times, minlength=len(words)).astype(np.int64)
            for i, ids in enumerate(own):
                for j, x in enumerate(ids):
                    flat[place[odd[of == i]] + j] = x
        return flat, length

    def keys(self, text: str) -> list[str]:
        """The words of a whole text as the lexicon names them. No piece has a blank after another character, so none crosses two of them."""
        if self.prefix and text and text[0] != " " and "  " not in text and BLANK not in text:
            return text.split(" ")
        return self.keys_of(self.normal(text))

    def keys_of(self, normal: str) -> list[str]:
        if normal[:1] == BLANK and BLANK * 2 not in normal:
            return normal.split(BLANK)[1:]
        return [w + BLANK if w[0] != BLANK else w if w[1:2] == BLANK else w[1:] for w in _WORDS.findall(normal)]

    def encode_all(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of many texts, given by their keys; new words of all of them are encoded together and remembered."""
        if self.lexicon.count > KEPT:
            self.lexicon = Lexicon(self)
        known = self.lexicon
        numbers = [np.fromiter(map(known.__getitem__, keys), np.int64, len(keys)) for keys in texts]
        known.settle()
        ids, length = known.ids_of(np.concatenate([np.zeros(0, np.int64), *numbers]))
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *map(len, numbers)])]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([self.keys(text)])[0]

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        return text_of(self.utf8, ids, first and self.prefix)

    # Chunks

    def states(self, text: str, boundary: int) -> list[State]:
        """The pieces that begin before a boundary of ``text`` and end at it or beyond."""
        if boundary == len(text):
            ends = [boundary]
        else:
            ends = list(range(boundary, min(len(text), boundary + self.longest - 1) + 1))
        found = [(i, j) for i in range(max(0, boundary - self.longest), boundary) for j in ends if j - i <= self.longest and (j - i == 1 or text[i:j] in self.scores)]
        return [(i - boundary, j - boundary) for i, j in found]

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place in [low, high] that no piece crosses: before a blank that follows another character."""
        found = [m.start() + 1 for m in _CUTS.finditer(text, max(0, low - 1), min(len(text), high + 1))]
        found = [x for x in found if low <= x <= high]
        return (found[0], found[-1]) if found else None

    def transfer(self, text: str, low: int, high: int, first: bool) -> tuple[list[State], list[State], np.ndarray]:
        """States at both boundaries of the chunk [low, high) of ``text``, which holds context on both sides, and its matrix."""
        entries = [(0, 0)] if first else self.states(text, low)
        exits = self.states(text, high)
        matrix = np.full((len(entries), len(exits)), NEVER)
        limit = min(len(text), high + self.longest - 1)
        cut_at = self.cuts(text, low, high)
        if cut_at is None:
            for row, (i, j) in enumerate(entries):
                if low + j <= high:
                    back, best = self.walk(text, low + i, low + j, limit)
                    self._reach(text, back, best, low + j, high, exits, matrix[row])
                elif (low + i - high, low + j - high) in exits:  # one piece spans the chunk
                    matrix[row, exits.index((low + i - high, low + j - high))] = 0.0
            return entries, exits, matrix
        head, tail = cut_at
        middle = 0.0 if self.bpe else sum(self.path_weight(w) for w in _WORDS.findall(text[head:tail]))
        out = np.full(len(exits), NEVER)
        if tail == high:
            ends = [k for k, (i, j) in enumerate(exits) if j == 0]
            if head == tail:  # entries lead straight to the cut, which is the boundary
                for row, (i, j) in enumerate(entries):
                    back, best = self.walk(text, low + i, low + j, high)
                    self._reach(text, back, best, low + j, high, exits, matrix[row])
                return entries, exits, matrix
            word = _WORDS.findall(text[head:tail])[-1]
            begin = tail - len(word)
            back, best = self.walk(text, begin, begin, tail)
            middle -= 0.0 if self.bpe else self.path_weight(word)
            for k in ends:
                i = high + exits[k][0]
                if i >= begin and best[i - begin] > NEVER and (back[-1] == i or not self.bpe):
                    out[k] = middle + best[i - begin] + self.weight(text[i:high])
        else:
            back, best = self.walk(text, tail, tail, limit)
            self._reach(text, back, best, tail, high, exits, out)
            out += middle
        for row, (i, j) in enumerate(entries):
            back, best = self.walk(text, low + i, low + j, head) if low + j <= head else ([], [NEVER])
            matrix[row] = best[-1] + out
        return entries, exits, matrix

    def path_weight(self, word: str) -> float:
        return self.walk(word, 0, 0, len(word))[1][-1]

    def _reach(self, text: str, back: list[int], best: list[float], at: int, high: int, exits: list[State], out: np.ndarray) -> None:
        """Weights of the exits from walked paths that start at the node ``at``."""
        for k, (i, j) in enumerate(exits):
            begin, end = high + i, high + j
            if begin < at:
                if end == at and begin == back[0]:
                    out[k] = 0.0
            elif self.bpe:
                if back[end - at] == begin and best[end - at] > NEVER:
                    out[k] = 0.0
            elif best[begin - at] > NEVER:
                out[k] = best[begin - at] + self.weight(text[begin:end])

    def emit(self, text: str, low: int, high: int, entry: State, leave: State) -> tuple[list[int], list[str], list[int]]:
        """The pieces from the end of the entry state to the end of the exit state: ids, then words (as keys), then ids."""
        at, end, begin = low + entry[1], high + leave[1], high + leave[0]
        if begin < at:
            return [], [], []
        last = list(self.piece_ids(text[begin:end]))
        cut_at = self.cuts(text, at, begin)
        if cut_at is None:
            back, _ = self.walk(text, low + entry[0], at, begin)
            return [x for piece in self.trace(text, back, at, begin) for x in self.piece_ids(piece)], [], last
        head, tail = cut_at
        back, _ = self.walk(text, low + entry[0], at, head)
        before = [x for piece in self.trace(text, back, at, head) for x in self.piece_ids(piece)]
        back, _ = self.walk(text, tail, tail, begin)
        after = [x for piece in self.trace(text, back, tail, begin) for x in self.piece_ids(piece)]
        return before, self.keys_of(text[head:tail]), after + last

    def emit_all(self, chunks: list[tuple[str, int, int, State, State]]) -> list[np.ndarray]:
        """Ids of many chunks whose states are known."""
        parts = [self.emit(*c) for c in chunks]
        middle = self.encode_all([keys for _, keys, _ in parts])
        return [np.concatenate([before, own, after]).astype(np.int32) for (before, _, after), own in zip(parts, middle)]


_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_CUTS = re.compile(f"[^{BLANK}](?={BLANK})")


def text_of(utf8: list[bytes], ids: np.ndarray, opening: bool) -> str:
    """The text of some pieces; ``opening``: they open a document, whose added blank goes."""
    text = b"".join(map(utf8.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if opening and text.startswith(" ") else text


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


Transfer = tuple[list[State], list[State], np.ndarray]


def product(parts: list[Transfer]) -> Transfer:
    """The transfer of neighbouring parts taken together."""
    matrix = parts[0][2]
    for _, _, own in parts[1:]:
        matrix = combine(matrix, own)
    return parts[0][0], parts[-1][1], matrix


def best_states(parts: list[Transfer], entry: State | None = None, leave: State | None = None) -> list[tuple[State, State]]:
    """Entry and exit state of every part on the best path, between two given states or whichever are best."""
    first = np.zeros((1, len(parts[0][0])))
    if entry is not None:
        first[0, [s != entry for s in parts[0][0]]] = NEVER
    vectors = [first]
    for _, _, matrix in parts:
        vectors.append(combine(vectors[-1], matrix))
    at = int(np.argmax(vectors[-1][0])) if leave is None else parts[-1][1].index(leave)
    out = []
    for (entries, exits, matrix), before in zip(reversed(parts), reversed(vectors[:-1])):
        came = int(np.argmax(before[0] + matrix[:, at]))
        out.append((entries[came], exits[at]))
        at = came
    return out[::-1]


MATRIX = "row_no long, node long, entries array<int>, exits array<int>, weights array<double>"


def flat(row_no: object, node: object, parts: list[Transfer]) -> pd.DataFrame:
    return pd.DataFrame({"row_no": row_no, "node": node, "entries": [np.array(e, np.int32).ravel() for e, _, _ in parts], "exits": [np.array(x, np.int32).ravel() for _, x, _ in parts], "weights": [m.ravel() for _, _, m in parts]})


def unflat(rows: pd.DataFrame) -> list[Transfer]:
    out = []
    for e, x, w in zip(rows["entries"], rows["exits"], rows["weights"]):
        entries, exits = ([tuple(p) for p in np.asarray(v).reshape(-1, 2).tolist()] for v in (e, x))
        out.append((entries, exits, np.asarray(w, float).reshape(len(entries), len(exits))))
    return out


def scan(transfers: DataFrame, fan: int = FAN) -> DataFrame:
    """row_no, node, a, b, c, d: entry (a, b) and exit (c, d) of every chunk on its document's best path.

    ``transfers`` has one row per chunk (node 0, 1, ... of a row_no). On the way
    up ``fan`` neighbours at a time become one product, until each document has
    at most ``fan`` of them; there the best states are chosen, and on the way
    down each product's states decide those of its members. No task ever has
    more than ``fan`` matrices of a group, however long a document is.
    """
    n = partitions(transfers.sparkSession)

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return flat(key[0], key[1], [product(unflat(rows.sort_values("node")))])

    def down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        a, b, c, d = rows[["a", "b", "c", "d"]].iloc[0]
        chosen = best_states(unflat(rows)) if pd.isna(a) else best_states(unflat(rows), (int(a), int(b)), (int(c), int(d)))
        found = np.array([[*e, *x] for e, x in chosen], np.int32).reshape(-1, 4)
        return pd.DataFrame({"row_no": key[0], "node": rows["node"].to_numpy(), "a": found[:, 0], "b": found[:, 1], "c": found[:, 2], "d": found[:, 3]})

    def grouped(level: DataFrame):
        # A number of partitions is given, as these rows are small and slow: they must not be put together into one task.
        return level.repartition(n, "row_no", "above").groupBy("row_no", "above")

    def above(level: DataFrame) -> DataFrame:
        return level.withColumn("above", F.floor(F.col("node") / fan))

    levels = [transfers]
    width = (transfers.agg(F.max("node")).first()[0] or 0) + 1
    while width > fan:
        levels.append(cut(grouped(above(levels[-1])).applyInPandas(up, MATRIX), "piece-products"))
        width = -(-width // fan)
    states = None
    for level in reversed(levels):
        own = above(level)
        if states is None:
            own = own.select("*", *[F.lit(None).cast("int").alias(c) for c in "abcd"])
        else:
            own = own.join(states.withColumnRenamed("node", "above"), ["row_no", "above"])
        states = grouped(own).applyInPandas(down, "row_no long, node long, a int, b int, c int, d int")
    return states


ENCODED = "doc_id long, row_no long, chunk int, ids array<int>, covered string"


def encode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Encode whole texts: doc_id, row_no, chunk, ids, covered (the stretch of the text that the ids stand for).

    Texts of up to ``chunk`` characters are encoded in place and have one row.
    Longer ones are cut into chunks that are spread over the cluster; they have
    one row for each chunk, so a giant document never stands in one task as a
    list of ids. Only matrices (at most some 10 KB each) meet, ``fan`` at a time.

    A null or empty text has one row without ids. Rows that repeat an id differ
    in row_no. Characters that the model doesn't have become bytes. U+2581 is a
    blank to the model, so ``covered`` has a blank in its place. An empty table
    gives an empty result; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(pieces.plain())
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(*shared.value)
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.iloc[low : low + 512]
                ids = own.encode_all([own.keys(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "row_no": part["row_no"], "chunk": np.int32(0), "ids": ids, "covered": part["text"].str.replace(BLANK, " ")})

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(*shared.value)
        side = 2 * own.longest
        for batch in batches:
            for doc_id, row_no, text in zip(batch["doc_id"], batch["row_no"], batch["text"]):
                s = own.normal(text)
                for nth, low in enumerate(range(0, len(s), chunk)):
                    high, left = min(low + chunk, len(s)), max(0, low - side)
                    yield pd.DataFrame({"doc_id": [doc_id], "row_no": [row_no], "chunk": [nth], "low": [low - left], "high": [high - left], "final": [high == len(s)], "part": [s[left : high + side]]})

    chunks = cut(
        rows.filter(long).mapInPandas(divide, "doc_id long, row_no long, chunk int, low int, high int, final boolean, part string"),
        "piece-chunks",
    )

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(*shared.value)
        for batch in batches:
            yield flat(batch["row_no"], batch["chunk"], [own.transfer(part, low, high, nth == 0) for part, low, high, nth in zip(batch["part"], batch["low"], batch["high"], batch["chunk"])])

    states = scan(cut(chunks.mapInPandas(matrices, MATRIX), "piece-transfers"), fan).withColumnRenamed("node", "chunk")

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(*shared.value)
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.iloc[at : at + 64]
                parts = [(part, low, high, (a, b), (c, d)) for part, low, high, a, b, c, d in zip(*(batch[x] for x in ("part", "low", "high", "a", "b", "c", "d")))]
                covered = [part[low + e[1] : high + x[1]].replace(BLANK, " ")[1 if nth == 0 and own.prefix else 0 :] for (part, low, high, e, x), nth in zip(parts, batch["chunk"])]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "row_no": batch["row_no"], "chunk": batch["chunk"], "ids": own.emit_all(parts), "covered": covered})

    # Chunks move once, here, which spreads a giant document over the cluster; the hint keeps small tables from taking another way.
    giant = chunks.join(states.hint("merge"), ["row_no", "chunk"]).select("doc_id", "row_no", "chunk", "low", "high", "part", "a", "b", "c", "d").mapInPandas(pieces_of, ENCODED)
    return rows.filter(~long).mapInPandas(whole, ENCODED).unionByName(giant)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Add ``decoded``, the text of each row's ids. Chunk 0 loses the blank that encoding put before the text.

    Null ids count as none; ids outside the model fail the query.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((pieces.utf8, pieces.prefix))

    @F.pandas_udf("string")
    def text(ids: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        utf8, prefix = shared.value
        for own, chunk in ids:
            yield pd.Series([text_of(utf8, np.zeros(0, np.int32) if i is None else np.asarray(i), prefix and c == 0) for i, c in zip(own, chunk)])

    return encoded.withColumn("decoded", text("ids", "chunk"))
