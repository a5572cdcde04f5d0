"""Whole-text encoding with a table of the pieces that stand between white space.

A text is cut where white space follows something else. Byte-level patterns start a new piece there
and the word vocabulary drops white space, so a text's ids are those of its pieces, one after the
other. Each distinct piece is encoded by the library once per worker and stage (or table period); all
others are found by a 64-bit hash in flat arrays, and compared byte for byte with what was encoded.
Texts that hold the string of a special token are handed to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

from bindery.llm.common import held
from bindery.llm.words import LOWER, Words

#: Pieces in a table before it starts anew, some 60 bytes apiece.
TABLE_PIECES = 1_000_000
#: Longer pieces aren't kept, so that the table is bounded in bytes too.
PIECE_BYTES = 128
#: New pieces that the library gets as one text, with a special token between each two.
JOINED = 256

#: White space that patterns may know beside the ASCII kinds that texts are cut at; its last bytes.
_OTHER_SPACE = [chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0x180E, 0xFEFF)]
_TAILS = np.zeros(256, bool)
_TAILS[[x[-1] for x in _OTHER_SPACE]] = True


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of all runs, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _after_other_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space of another kind ends before each place of ``at``; may say yes too often, never too seldom."""
    out = _TAILS[data[at - 1]]
    for k in np.flatnonzero(out):
        before = data[max(0, at[k] - 3) : at[k]].tobytes()
        out[k] = any(before.endswith(x) for x in _OTHER_SPACE)
    return out


class PieceTable:
    """Encodes blocks of texts to one flat id array and a count per text."""

    def __init__(self, encode, whole=None, words_only: bool = False, lowers: bool = False, special: re.Pattern | None = None, most: int = TABLE_PIECES):
        """``encode`` gives (flat ids, ids per piece) of pieces without special strings, ``whole`` of any texts.

        ``words_only``: white space has no ids; ``lowers``: A-Z have the ids of a-z; ``special`` matches the bytes of
        special strings, all of which begin with one byte that is no letter.
        """
        self.encode_pieces, self.encode_whole = encode, whole or encode
        self.words_only, self.lowers, self.special, self.most = words_only, lowers, special, most
        self.lead = special.pattern.replace(b"\\", b"")[:1] if special else b""
        self.reset()

    def reset(self) -> None:
        n = 1 << 12
        self.hashes = np.zeros(n, np.uint64)
        self.starts, self.sizes = np.zeros(n, np.int32), np.zeros(n, np.int32)  # of the piece's ids
        self.begins, self.lengths = np.zeros(n, np.int32), np.zeros(n, np.int32)  # of its bytes
        self.flat, self.store = np.zeros(4 * n, np.uint32), np.zeros(8 * n, np.uint8)
        self.count = self.used = self.stored = 0
        self.slots = np.full(4 * n, -1, np.int32)

    def _grown(self, name: str, size: int) -> np.ndarray:
        own = getattr(self, name)
        if size > len(own):
            more = np.zeros(max(size, len(own) * 3 // 2), own.dtype)
            more[: len(own)] = own
            setattr(self, name, more)
        return getattr(self, name)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Codes of pieces that have these ids."""
        m, n = len(sizes), len(ids)
        self._grown("flat", self.used + n)[self.used : self.used + n] = ids
        self._grown("sizes", self.count + m)[self.count : self.count + m] = sizes
        self._grown("starts", self.count + m)[self.count : self.count + m] = self.used + np.cumsum(sizes) - sizes
        codes = np.arange(self.count, self.count + m)
        self.count, self.used = self.count + m, self.used + n
        return codes

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        codes = self.slots[slot]
        open_ = np.flatnonzero((codes >= 0) & (self.hashes[codes] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            codes[open_] = self.slots[slot[open_]]
            open_ = open_[(codes[open_] >= 0) & (self.hashes[codes[open_]] != h[open_])]
        return codes.astype(np.int64)

    def _place(self, codes: np.ndarray) -> None:
        mask, slot = len(self.slots) - 1, (self.hashes[codes] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(codes):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = codes[free]
            again = self.slots[slot] != codes
            codes, slot = codes[again], (slot[again] + 1) & mask

    def _add(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Keeps new pieces of these hashes."""
        texts = [x.decode() for x in pieces]
        first = self.count
        codes = self._append(*self.encode_pieces(texts))
        m, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        self._grown("store", self.stored + len(joined))[self.stored : self.stored + len(joined)] = joined
        self._grown("lengths", first + m)[first : first + m] = lengths
        self._grown("begins", first + m)[first : first + m] = self.stored + np.cumsum(lengths) - lengths
        self._grown("hashes", first + m)[first : first + m] = h
        self.stored += len(joined)
        if 2 * self.count > len(self.slots):
            self.slots = np.full(1 << (4 * self.count - 1).bit_length(), -1, np.int32)
            codes = np.arange(self.count)
        self._place(codes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of the texts data[offsets[i]:offsets[i + 1]], in UTF-8."""
        if self.count > self.most or self.used > 16 * self.most:
            self.reset()
        raw, low = data, LOWER[data] if self.lowers else data
        w = Words(low, offsets)
        if self.words_only:
            begin, end = w.starts, w.ends
            if len(begin):
                cut = np.zeros(len(begin), bool)
                cut[1:] = ~_after_other_space(low, w.ends[:-1])
                cut[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
                if not cut.all():
                    begin, end = begin[cut], end[np.append(np.flatnonzero(cut)[1:], len(cut)) - 1]
        else:
            marks = np.zeros(len(low) + 1, bool)
            marks[w.ends[~_after_other_space(low, w.ends)]] = True
            marks[offsets] = True
            marks[-1] = False
            begin = np.flatnonzero(marks)
            end = np.append(begin[1:], len(low)) if len(begin) else begin
        special = np.empty(0, np.int64)
        if self.special is not None:
            whole = raw.tobytes()
            found = [m.start() for m in self.special.finditer(whole)] if self.lead in whole else []
            special = np.unique(np.searchsorted(offsets, found, "right") - 1)
        if len(special):  # each of these texts is one piece
            text = np.searchsorted(offsets, begin, "right") - 1
            keep = ~np.isin(text, special)
            begin, end = np.concatenate([begin[keep], offsets[special]]), np.concatenate([end[keep], offsets[special + 1]])
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], end[order]
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        sizes = end - begin
        long = sizes > PIECE_BYTES
        if len(special):
            long |= np.isin(begin, offsets[special])
        h = w.run_hashes(begin, end)
        codes = np.full(len(begin), -1, np.int64)
        brief = np.flatnonzero(~long)
        codes[brief] = self._find(h[brief])
        unknown = brief[codes[brief] < 0]
        if len(unknown):
            own, at = np.unique(h[unknown], return_index=True)
            at = unknown[at]
            order = np.argsort(at)
            at, own = at[order], own[order]
            whole = low.tobytes()
            for i in range(0, len(at), 65536):
                self._add(own[i : i + 65536], [whole[a:b] for a, b in zip(begin[at[i : i + 65536]].tolist(), end[at[i : i + 65536]].tolist())])
            codes[unknown] = self._find(h[unknown])
        same = codes >= 0
        k = codes[same]
        match = self.lengths[k] == sizes[same]
        n = np.where(match, sizes[same], 0)
        differ = low[ragged(begin[same], n)] != self.store[ragged(self.begins[k].astype(np.int64), n)]
        if differ.any():
            match[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(differ), "right"))] = False
        codes[np.flatnonzero(same)[~match]] = -1
        count, used = self.count, self.used
        loose = np.flatnonzero(codes < 0)
        if len(loose):
            whole = raw.tobytes()
            codes[loose] = self._append(*self.encode_whole([whole[a:b].decode() for a, b in zip(begin[loose].tolist(), end[loose].tolist())]))
        n = self.sizes[codes].astype(np.int64)
        flat = self.flat[ragged(self.starts[codes].astype(np.int64), n)]
        self.count, self.used = count, used
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(ends[np.searchsorted(begin, offsets)])


def load(path: str, plain: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain
    return tokenizer


@functools.lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size(with_added_tokens=True)


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def table(path: str, plain: bool = False) -> PieceTable:
    """One per worker, vocabulary and stage. ``plain``: special tokens' strings are ordinary text, else what the library takes them for."""
    return held(("pieces", path, plain), lambda: _table(path, plain))


def _table(path: str, plain: bool) -> PieceTable:
    tokenizer, joiner = load(path, plain), load(path)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    lowers = '"Lowercase"' in tokenizer.to_str()[:4096]
    words_only = not tokenizer.encode(" \n a", add_special_tokens=False).ids[1:] and bool(tokenizer.encode("a", add_special_tokens=False).ids)

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    if not added:
        return PieceTable(whole, whole, words_only, lowers)
    if len({x[:1] for x in added}) > 1 or next(iter(added))[:1].isalnum():
        raise ValueError("special tokens are taken to begin with one mark")
    mark, number = next(iter(added.items()))

    def joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Special tokens part what stands beside them, so pieces with one between are encoded apart."""
        ids, sizes = [], []
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            own = np.array(joiner.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(own == number)
            bounds = np.concatenate([[-1], at, [len(own)]])
            ids.append(np.delete(own, at))
            sizes.append(np.diff(bounds) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    return PieceTable(joined, whole, words_only, lowers, re.compile(b"|".join(re.escape(x.encode()) for x in added), re.I))
