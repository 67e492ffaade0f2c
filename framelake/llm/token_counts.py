"""Token counts by compiled finite-state transducers.

Two transducers, both deterministic:

1. The splitter reads classes of characters and marks where a piece of the
   byte-level pattern starts (letters, numbers, other characters, each with
   an optional space before; contractions; white space). A slice of text is
   cut into chunks of equal length, each chunk's map from entry state to exit
   state is computed for all states at once, the maps are composed by a
   parallel prefix scan, and a second pass from the now known entry states
   marks the starts.
2. The merger reads the bytes of one piece; the tokens that a transition
   emits (perhaps less than none, as more bytes can merge what came before)
   are its annotation, and their sum is the piece's count. A state is the
   set of tokens that may yet be completed, each with the last token before
   it and its count relative to the present one. Of the tokens that end at a
   byte just one fits the last token before it (a pair fits if the merge
   rules leave it as it is), so the machine is deterministic. It is compiled
   lazily, and emptied where it grows beyond ``MOST_STATES``. Its states aren't bounded by the
   vocabulary, so maps over all entry states can't be tabulated: long pieces compose
   the count-annotated maps of their blocks from the one state that each is entered in.

Special strings inside texts count as one token and part the text, which is
the library's default. Defined results: null and empty texts have 0 tokens
and 0 bytes; each row is counted by itself, so repeated rows get equal counts.
Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm._arrow import slices, span_hashes, utf8
from framelake.llm._scratch import bounded

LIMIT = 1024
MOST_STATES = 200_000
MOST_PIECES = 400_000
#: Bytes of a piece whose count is remembered, at most, and of a block of longer ones.
_SHORT, _BLOCK = 64, 16

# Classes of characters; white space and apostrophes also look ahead.
_L, _N, _P, _Q, _Q2, _Q3, _S_LAST, _S_MID, _W_LAST, _W_MID = range(10)
_CLASSES = 10
# States: what was read last.
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _SPACE, _WHITE, _ONE_MORE, _TWO_MORE = range(8)
_STATES = 8
_CHUNK = 64
_NEVER = 1 << 30


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and whether a piece starts at this character."""
    if state in (_ONE_MORE, _TWO_MORE):
        return (_FRESH if state == _ONE_MORE else _ONE_MORE), 0
    if kind in (_L, _N, _P, _Q):
        own = {_L: _LETTERS, _N: _NUMBERS, _P: _OTHERS, _Q: _OTHERS}[kind]
        return own, int(state not in (own, _SPACE))
    if kind in (_Q2, _Q3):
        if state in (_OTHERS, _SPACE):
            return _OTHERS, 0
        return (_ONE_MORE if kind == _Q2 else _TWO_MORE), 1
    if kind == _S_LAST:
        return _SPACE, 1
    if kind == _W_LAST:
        return _FRESH, 1
    return _WHITE, int(state != _WHITE)


#: [class, + _CLASSES at the first character of a row][state]
_NEXT = np.zeros((2 * _CLASSES, _STATES), np.uint8)
_STARTS = np.zeros((2 * _CLASSES, _STATES), bool)
for _k in range(_CLASSES):
    for _s in range(_STATES):
        _NEXT[_k, _s], _STARTS[_k, _s] = _step(_s, _k)
        _NEXT[_k + _CLASSES, _s], _STARTS[_k + _CLASSES, _s] = _step(_FRESH, _k)


@cache
def _kinds() -> np.ndarray:
    """Letter, number, white space (8: a space is told apart later) or other, of each code point."""
    kinds = np.full(sys.maxunicode + 1, _P, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = _L
        elif major == "N":
            kinds[c] = _N
    # White_Space of Unicode, fixed values
    kinds[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _W_MID
    return kinds


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points; ``first`` has the positions at which rows start."""
    kind = _kinds()[points]
    white = kind == _W_MID
    follows = np.zeros(len(points), bool)  # something other than white space comes next in the row
    follows[:-1] = ~white[1:]
    follows[first[first > 0] - 1] = False
    out = kind.copy()
    space = points == 0x20
    out[white & follows] = _W_LAST
    out[space & ~follows] = _S_MID
    out[space & follows] = _S_LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        row_end = np.append(first, len(points))[np.searchsorted(first, quotes, "right")]
        padded = np.append(points, [0, 0])
        a, b = padded[quotes + 1], padded[quotes + 2]
        two = np.isin(a, [ord(x) for x in "stmd"]) & (quotes + 1 < row_end)
        three = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quotes + 2 < row_end)
        out[quotes] = np.where(two, _Q2, np.where(three, _Q3, _Q))
    at = first[first < len(points)]
    out[at] += _CLASSES
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Where pieces start: chunk maps, their prefix scan, and a pass that marks."""
    n = len(sym)
    chunks = -(-n // _CHUNK)
    grid = np.zeros(chunks * _CHUNK, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(chunks, _CHUNK).T)
    flat_next, flat_start = _NEXT.ravel(), _STARTS.ravel()
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (chunks, 1))
    base = grid.astype(np.intp) * _STATES
    for j in range(_CHUNK):
        maps = flat_next[base[j][:, None] + maps]
    reach = 1
    while reach < chunks:  # maps[i] becomes the map of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[:-1, _FRESH]
    marks = np.zeros((_CHUNK, chunks), bool)
    for j in range(_CHUNK):
        at = base[j] + state
        marks[j] = flat_start[at]
        state = flat_next[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The second transducer, over a byte-level vocabulary and its merge rules."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {x["content"] for x in spec["added_tokens"]}
        self.special = [s.encode() for s in special]
        self.token = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # rank of a merge by the tokens it joins, and the merge that makes a token
        self.ranks: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            x, y = self.token[raw(left)], self.token[raw(right)]
            self.ranks[x << 20 | y] = k
            self.parts[self.token[raw(left) + raw(right)]] = (x, y, k)
        self.spines: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in self.token.items():
            at = 0
            for b in t:
                at = self.children[at].setdefault(b, len(self.children))
                if at == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[at] = i
        self.fits: dict[int, bool] = {}
        self.counts: dict[bytes, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.states: dict[tuple, int] = {((-1, 0, 0),): 0}
        self.what: list[tuple] = [((-1, 0, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        #: Maps of blocks of bytes: (state, block) to (state, tokens emitted).
        self.jumps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def _spines(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """What stands at the right and at the left end of a token as it is
        merged, from the byte up, each with the rank at which it is merged on."""
        found = self.spines.get(token)
        if found is None:
            found = ([], [])
            for side, out in ((1, found[0]), (0, found[1])):
                at, rank = token, _NEVER
                while True:
                    out.append((at, rank))
                    if at not in self.parts:
                        break
                    at, rank = self.parts[at][side], self.parts[at][2]
                out.reverse()
            self.spines[token] = found
        return found

    def _fit(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both, by rank and from the left, leaves the pair as it is."""
        if last < 0:
            made = self.parts.get(token)
            return made is None or self._pair(*made)
        return self._pair(last, token, _NEVER)

    def _pair(self, left: int, right: int, until: int) -> bool:
        key = left << 20 | right
        found = self.fits.get(key) if until == _NEVER else None
        if found is None:
            a, b = self._spines(left)[0], self._spines(right)[1]
            i = j = 0
            ranks, found = self.ranks, True
            while True:
                (x, p), (y, q) = a[i], b[j]
                joint = ranks.get(x << 20 | y, _NEVER)
                if joint < min(p, until) and joint <= q:
                    found = False
                    break
                if p == q == _NEVER:
                    break
                if p <= q:
                    i += 1
                else:
                    j += 1
            if until == _NEVER:
                if len(self.fits) > 1_000_000:
                    self.fits.clear()
                self.fits[key] = found
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        alive, newest, count = [], -1, 0
        for last, node, relative in self.what[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if newest < 0 and (t := self.ends[child]) >= 0 and self._fit(last, t):
                newest, count = t, relative + 1
            if self.children[child]:
                alive.append((last, child, relative))
        assert newest >= 0, "each byte is a token"
        what = (*((a, b, c - count) for a, b, c in alive), (newest, 0, 0))
        to = self.states.setdefault(what, len(self.what))
        if to == len(self.what):
            self.what.append(what)
            self.moves.append({})
        move = (to, count)
        self.moves[state][byte] = move
        return move

    def count(self, piece: bytes) -> int:
        found = self.counts.get(piece)
        if found is None:
            if len(self.what) > MOST_STATES:
                self._empty()
            if len(self.counts) > MOST_PIECES:
                self.counts.clear()
            state = found = 0
            if len(piece) <= _SHORT:
                found = self._run(state, piece)[1]
                self.counts[piece] = found
            else:
                for at in range(0, len(piece), _BLOCK):
                    state, emitted = self._block(state, piece[at : at + _BLOCK])
                    found += emitted
        return found

    def _run(self, state: int, piece: bytes) -> tuple[int, int]:
        """The state after some bytes, and the tokens emitted on the way."""
        found, moves = 0, self.moves
        for b in piece:
            move = moves[state].get(b)
            if move is None:
                move = self._compile(state, b)
            state, emitted = move
            found += emitted
        return state, found

    def _block(self, state: int, block: bytes) -> tuple[int, int]:
        """The same of one block of a long piece, from its map where that was met before."""
        found = self.jumps.get((state, block))
        if found is None:
            if len(self.what) > 2 * MOST_STATES or len(self.jumps) > MOST_PIECES:  # within one very long piece
                what = self.what[state]
                self._empty()
                self.what.append(what)
                self.moves.append({})
                self.states[what] = state = 1
            found = self.jumps[state, block] = self._run(state, block)
        return found


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(data: np.ndarray, offsets: np.ndarray, machine: Merger) -> np.ndarray:
    """Tokens of each row of a slice."""
    rows = len(offsets) - 1
    raw = data.tobytes()
    extra = np.zeros(rows, np.int64)
    owner = None
    if any(s in raw for s in machine.special):
        # special strings part a row into rows of their own
        cuts, ends, parts = [], offsets.tolist(), []
        for r in range(rows):
            at, stop = ends[r], ends[r + 1]
            while True:
                k, s = min(((raw.find(s, at, stop), s) for s in machine.special if raw.find(s, at, stop) >= 0), default=(-1, b""))
                cuts.append(r)
                if k < 0:
                    parts.append(raw[at:stop])
                    break
                parts.append(raw[at:k])
                extra[r] += 1
                at = k + len(s)
        raw, owner = b"".join(parts), np.array(cuts)
        data = np.frombuffer(raw, np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    if not raw:
        return extra
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        byte_at, first = None, offsets[:-1]
    else:
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(byte_at, offsets[:-1])
    first = np.unique(first[first < len(points)])
    starts = piece_starts(symbols(points, first))
    if byte_at is not None:
        starts = byte_at[starts]
    ends = np.append(starts[1:], len(raw))
    _, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    count = machine.count
    each = np.array([count(raw[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], np.int64)[inverse]
    total = np.concatenate(([0], np.cumsum(each)))
    bounds = total[np.searchsorted(starts, offsets)]
    own = np.diff(bounds)
    if owner is not None:
        own = np.bincount(owner, own, rows).astype(np.int64)
    return own + extra


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text, by the vocabulary file at ``path`` (the same on all executors)."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = merger(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [count_tokens(d, o, machine) for _, _, d, o in slices(data, offsets)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
