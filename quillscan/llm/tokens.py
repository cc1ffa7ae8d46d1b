"""Exact ids of a lower-casing word BPE tokenizer, mostly in numpy.

The tokenizer normalises (NFC, white space, lower case), cuts the text into contractions, letters, single digits and
other runs, and encodes each piece by itself. For rows below U+0250, which NFC leaves alone, the same cutting is done
here on arrays of code points; each distinct piece is encoded once and looked up by a 64-bit hash from then on. Any other
row goes to the tokenizer whole. The ids are its own in either case.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from quillscan.llm.kernels import U, mix, powers

#: Pieces, and ids of them all, that the table keeps before it begins anew (some 20 bytes and 4 bytes each); a row with a
#: longer piece isn't cut here.
_MOST, _MOST_IDS, _LONGEST = 2_000_000, 8_000_000, 1024
_TOP, _TABLE = 0x250, 0x10000
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _kind(c: str) -> int:
    if c == "İ" or "\x1c" <= c <= "\x1f":
        return _ODD
    if c.isspace():
        return _SPACE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER)


# beyond _TOP for retrieval only
_KIND = np.array([_kind(chr(i)) for i in range(_TABLE)] + [_OTHER], np.int8)
_LOW = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(_TABLE)] + [0], np.uint32)


def _alone(points: np.ndarray) -> np.ndarray:
    """Which code points are pieces by themselves: those of scripts without blanks (Han, kana, Yi) and symbols beyond."""
    return ((points >= 0x2E80) & (points < 0xA4D0)) | ((points >= 0xF900) & (points < 0xFB00)) | (points >= _TABLE)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(0x100 + extra))
        extra += b not in plain
    return out


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slot = np.zeros(0, U), np.zeros(0, np.int32)  # known pieces in order of their hashes
        self.ids, self.used, self.n = np.zeros(1 << 18, np.uint32), 0, 0
        self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        word = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [self._piece(p) for p in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        k, size = self.n, int(lengths.sum())
        while k + len(found) > len(self.begin):
            self.begin, self.length = np.concatenate((self.begin, self.begin)), np.concatenate((self.length, self.length))
        while self.used + size > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.ids[self.used : self.used + size] = [i for ids in found for i in ids]
        self.length[k : k + len(found)] = lengths
        self.begin[k : k + len(found)] = self.used + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slot = np.insert(self.slot, at, np.arange(k, k + len(found), dtype=np.int32))
        self.used += size
        self.n += len(found)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of UTF-8 rows (see ``kernels.buffers``): all ids, where each row's begin (with the end as last); and a number
        for each piece, for retrieval, with the rows' places likewise (of all rows, also those that go to the tokenizer whole)."""
        if self.n > _MOST or self.used > _MOST_IDS:
            self._clear()
        rows = len(offsets) - 1
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        clipped = np.minimum(points, _TABLE)
        kind, low = _KIND[clipped], np.where(points < _TABLE, _LOW[clipped], points)
        odd = np.zeros(rows, bool)
        odd[np.searchsorted(at, np.flatnonzero((kind == _ODD) | (points >= _TOP)), "right") - 1] = True
        bar = np.flatnonzero((points[:-1] == 60) & (points[1:] == 124))
        odd[np.searchsorted(at, bar, "right") - 1] = True  # "<|": perhaps one of the special tokens

        n = len(points)
        alone = _alone(points)
        edge = np.ones(n + 1, bool)
        edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | (alone[1:] | alone[:-1])
        edge[at] = True
        start = np.flatnonzero(edge[:n] & (kind != _SPACE))
        end = np.append(np.flatnonzero(edge), n)  # each start's next edge
        end = end[np.searchsorted(end, start, "right")]
        start, end = self._contractions(low, kind, start, end)
        long = np.flatnonzero(end - start > _LONGEST)
        odd[np.searchsorted(at, start[long], "right") - 1] = True
        row = np.searchsorted(at, start, "right") - 1
        lengths = end - start
        if len(start):
            cs = np.cumsum(lengths) - lengths
            inside = np.arange(int(lengths.sum())) - np.repeat(cs, lengths)
            h = np.add.reduceat((low[np.repeat(start, lengths) + inside].astype(U) + U(1)) * powers(int(lengths.max()))[inside], cs)
            h = mix(h + lengths.astype(U) * U(0xD6E8FEB86659FD93))
        else:
            h = np.zeros(0, U)
        terms, terms_at = h.view(np.int64), np.searchsorted(row, np.arange(rows + 1))
        good = ~odd[row]  # ids of other rows are not looked up by pieces
        start, end, row, h = start[good], end[good], row[good], h[good]
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        found = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        there = found < len(self.hashes)
        new[there] = self.hashes[found[there]] != distinct[there]
        if new.any():
            text = low.tobytes()
            self._learn(distinct[new], [text[4 * start[k] : 4 * end[k]].decode("utf-32-le") for k in first[new]])
        which = self.slot[np.searchsorted(self.hashes, distinct)][back] if len(distinct) else np.zeros(0, np.int64)

        size = self.length[which].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        pieces_at = np.searchsorted(row, np.arange(rows + 1))
        ids_at = np.concatenate(([0], ends))[pieces_at]
        if odd.any():
            parts, sizes = [], np.diff(ids_at)
            for r in range(rows):
                if odd[r]:
                    parts.append(self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8")))
                    sizes[r] = len(parts[-1])
                else:
                    parts.append(ids[ids_at[r] : ids_at[r + 1]])
            ids, ids_at = np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
        return ids, ids_at, terms, terms_at

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A lone apostrophe takes s, t, m, d, re, ve or ll from the letters right after it."""
        k = np.flatnonzero((low[start] == 39) & (end - start == 1))
        k = k[k + 1 < len(start)]
        k = k[(start[k + 1] == end[k]) & (kind[start[k + 1]] == _LETTER)]
        if not len(k):
            return start, end
        a = low[start[k + 1]]
        two = end[k + 1] - start[k + 1] > 1
        b = np.where(two, low[np.minimum(start[k + 1] + 1, len(low) - 1)], 0)
        r, v, e, l = 114, 118, 101, 108
        take = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(two & ((np.isin(a, [r, v]) & (b == e)) | ((a == l) & (b == l))), 2, 0))
        k, take = k[take > 0], take[take > 0]
        start, end = start.copy(), end.copy()
        end[k] += take
        start[k + 1] += take
        left = end > start
        return start[left], end[left]

    def encode(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: a later task finds the table that earlier ones have filled."""
    return WordTokenizer(path)
