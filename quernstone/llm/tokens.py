"""Token ids of whole texts by the installed tokenizers library, with a word cache.

Both vocabularies cut a text into pretokens before they merge bytes, and no
token crosses a pretoken. A text can therefore be cut at places that are
pretoken boundaries in any context and each distinct piece encoded once; the
ids equal those of the whole text. Texts with white space other than blank and
newline, or with a special token's string, are encoded whole.

Many texts are cut and looked up together as arrays of bytes. A piece of up to
16 bytes is its own key, so a look-up compares whole pieces and never a hash alone.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from quernstone.llm.shared import tokens_path

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"""!"#$%&()*+,./:;<=>?@\^_`{|}~-"""  # not the apostrophe, which begins contractions
_WORD = re.compile(rf" ?[{_LATIN}]+")
_ODD_NARROW = ("\0", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")
_ODD_WIDE = re.compile(r"[^\S \n]")
_OTHER, _LETTER, _MARK, _BLANK, _NEWLINE = range(5)
_CLASS = bytes(_BLANK if c == 32 else _NEWLINE if c == 10 else _MARK if chr(c) in _MARKS else _LETTER if c < 128 and chr(c).isalpha() else _OTHER for c in range(256))
#: Pieces that a worker remembers, at about 40 bytes each; then it forgets those met once, or all if that frees less than half.
CACHE_PIECES = 600_000
#: Bytes that are cut at once; a longer piece makes more.
BLOCK = 1 << 18
_SLOT_BITS = 21
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _cuts(raw: bytes) -> np.ndarray:
    """Where pieces of UTF-8 text begin, but for its first byte.

    Before white space that follows something else, between a letter and a mark,
    and between a lone newline and a letter.
    """
    u = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(bytearray(raw.translate(_CLASS)), np.uint8)
    if not raw.isascii():
        two = np.flatnonzero(u[:-1] == 0xC3)  # À to ÿ, but × and ÷
        two = two[(u[two + 1] != 0x97) & (u[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = _LETTER
    letter, white = kind == _LETTER, kind >= _BLANK
    cut = np.zeros(len(u), bool)
    cut[1:] = white[1:] & ~white[:-1] | letter[:-1] & (kind[1:] == _MARK)
    after = letter[1:] & (kind[:-1] == _NEWLINE)
    after[1:] &= ~white[:-2]
    cut[1:] |= after
    return cut


class Encoder:
    """Ids of texts as arrays of unsigned 16-bit integers; holds the ids of the pieces met so far."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokens_path(name))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name} has more than 65,536 ids")
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # this class remembers whole pieces; looking twice costs a quarter of a miss
        self.spaced = name.startswith("byte_bpe")  # its tokens hold the blank before a word
        self.table = dict(enumerate(_byte_letters()))
        self.blank = self.table[0x20]
        self._forget()

    def _forget(self) -> None:
        self.long: dict[bytes, int] = {}  # pieces above 16 bytes
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)  # the piece last met with this hash
        # Piece 0 is none. Of each piece its first 16 bytes, where its ids are and how many, and whether it was met again.
        self.n = 1
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.at, self.size, self.again = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, bool)
        self.n_ids, self.ids = 0, np.zeros(1, np.uint16)

    def _trim(self) -> None:
        """Forgets the pieces that were not met again."""
        again = self.again[: self.n]
        if again.sum() > CACHE_PIECES // 2:
            return self._forget()
        again[0] = True  # none
        old = np.flatnonzero(again)
        size = self.size[old]
        place = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.at[old] - place, size) + np.arange(size.sum())]
        new = np.cumsum(again, dtype=np.int32) - 1
        self.long = {raw: int(new[k]) for raw, k in self.long.items() if again[k]}
        self.slots = np.where(again[self.slots], new[self.slots], 0).astype(np.int32)
        self.n, self.n_ids = len(old), len(self.ids)
        self.low, self.high, self.at, self.size, self.again = self.low[old], self.high[old], place, size, np.zeros(len(old), bool)

    def _piece(self, raw: bytes) -> list[int]:
        """Plain words go straight to the merge model, other pieces through the whole tokenizer."""
        piece = raw.decode()
        if not _WORD.fullmatch(piece):
            return self.whole(piece)
        word = piece if self.spaced else piece.strip(" ").lower()
        # The merge model reads bytes as the letters of its own alphabet.
        letters = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(letters)]

    def _learn(self, raws: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        """Adds distinct pieces."""
        found, ends, piece = array("H"), [0], self._piece
        for r in raws:
            found.extend(piece(r))
            ends.append(len(found))
        ids, size = np.frombuffer(found, np.uint16), np.diff(ends)
        n, n_ids = self.n + len(raws), self.n_ids + len(ids)
        if n > len(self.at):
            room = n + n // 2
            self.low, self.high, self.at, self.size, self.again = (_grown(a, room) for a in (self.low, self.high, self.at, self.size, self.again))
        if n_ids > len(self.ids):
            self.ids = _grown(self.ids, n_ids + n_ids // 2)
        self.low[self.n : n], self.high[self.n : n], self.size[self.n : n], self.again[self.n : n] = low, high, size, False
        self.at[self.n : n] = self.n_ids + np.cumsum(size) - size
        self.ids[self.n_ids : n_ids] = ids
        self.n, self.n_ids = n, n_ids

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece; new pieces get theirs."""
        words = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")
        wide, shift = ends - starts, (starts % 8 * 8).astype(np.uint64)
        at, back = starts // 8, np.uint64(63) - shift
        one, two, three = words[at], words[at + 1], words[at + 2]
        low = (one >> shift | two << np.uint64(1) << back) & _MASK[np.minimum(wide, 8)]
        high = (two >> shift | three << np.uint64(1) << back) & _MASK[np.clip(wide - 8, 0, 8)]
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        slot = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        number, short = self.slots[slot], wide <= 16
        hit = (self.low[number] == low) & (self.high[number] == high) & short
        miss = np.flatnonzero(~hit)
        other = self.slots[slot[miss] ^ 1]  # a hash has two slots
        there = (self.low[other] == low[miss]) & (self.high[other] == high[miss]) & short[miss]
        number[miss[there]] = other[there]
        hit[miss[there]] = True
        miss = miss[~there]
        self.again[number[hit]] = True
        if len(miss):
            raws = [raw[a:z] for a, z in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
            new = {r: i for r, i in zip(raws, miss.tolist(), strict=True) if r not in self.long}
            if new:
                first = np.fromiter(new.values(), np.int64, len(new))
                numbers = dict(zip(new, range(self.n, self.n + len(new)), strict=True))
                self._learn(list(new), low[first], high[first])
                kept = first[short[first]]
                place = slot[kept]
                place ^= self.slots[place] > 0
                self.slots[place] = number[kept] = np.arange(self.n - len(new), self.n, dtype=np.int32)[short[first]]
            else:
                numbers = {}
            number[miss] = [numbers.get(r) or self.long[r] for r in raws]
            self.again[[self.long[r] for r in raws if r in self.long]] = True
            self.long |= {r: k for r, k in numbers.items() if len(r) > 16}
        return number

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        odd = [bool(t) and _odd(t) for t in texts]
        plain = iter(self._encode([(t or "").encode() for t, o in zip(texts, odd, strict=True) if not o]))
        return [np.array(self.whole(t), np.uint16) if o else next(plain) for t, o in zip(texts, odd, strict=True)]

    def _encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        raw = b"".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        places = np.zeros(len(bounds), np.int64)  # the ids before each text
        found: list[np.ndarray] = []
        begin, most, total = 0, BLOCK, 0
        while begin < len(raw):
            if self.n > CACHE_PIECES:
                self._trim()
            block = raw[begin : begin + most]
            cut = _cuts(block)
            i, j = np.searchsorted(bounds, [begin, begin + len(block)])
            cut[bounds[i:j] - begin] = True
            cut[0] = True
            starts = np.flatnonzero(cut)
            if begin + len(block) < len(raw):  # the last piece may go on
                if len(starts) == 1:
                    most *= 2
                    continue
                starts, ends = starts[:-1], starts[1:]
            else:
                ends = np.append(starts[1:], len(block))
            number = self._numbers(block, starts, ends)
            size = self.size[number].astype(np.int64)
            upto = np.cumsum(size)
            ids = self.ids[np.repeat(self.at[number] - upto + size, size) + np.arange(upto[-1])]
            j = np.searchsorted(bounds, begin + ends[-1])
            places[i:j] = total + (upto - size)[np.searchsorted(starts, bounds[i:j] - begin)]
            found.append(ids)
            begin, most, total = begin + int(ends[-1]), BLOCK, total + len(ids)
        places[np.searchsorted(bounds, len(raw)) :] = total
        ids = np.concatenate(found) if found else np.zeros(0, np.uint16)
        return (ids[a:z] for a, z in zip(places[:-1].tolist(), places[1:].tolist(), strict=True))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


def _odd(text: str) -> bool:
    """Whether a text holds other white space or what may be a special token."""
    if any(c in text for c in _ODD_NARROW):
        return True
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_ODD_WIDE.search(text))
    return False


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(name)
