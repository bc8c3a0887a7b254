"""Token ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library.

The library cuts a text into pieces that never straddle a boundary between words, and the ids of
a piece don't depend on what surrounds it. So a batch of texts is cut at sure boundaries in its
UTF-8 bytes, Arrow finds the distinct pieces, each of them goes through the library's model once per
worker, and texts are put together from the ids of their pieces.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: A worker forgets its pieces when they hold about so many bytes, so its memory stays bounded.
MAX_BYTES = 160_000_000
#: Bytes of text that are encoded at a time; a longer text is encoded on its own.
BATCH_BYTES = 4_000_000
#: Longer pieces (in bytes) hardly come back: they are encoded and not kept.
LONG_PIECE = 128

#: The byte-level pre-tokenizer's own pattern: a fixed value of the vocabulary's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beyond ASCII, and characters that only one of two regex engines takes for it.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")
#: Special tokens begin with it.
MARK = "<|"

_WHITE, _WORD, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[b for b in range(128) if chr(b).isalnum()]] = _WORD
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE

_CODES = [np.array([int.from_bytes(m.encode()) for m in (*ODD, MARK) if len(m.encode()) == n], dtype=np.uint32) for n in (1, 2, 3)]
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[m.encode()[0] for m in (*ODD, MARK)]] = True


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _Pieces:
    """The place of each piece (its UTF-8 bytes) in the pool of ids."""

    def __init__(self, model, whole):
        self.model, self.whole = model, whole
        self.pattern = regex.compile(PATTERN)
        self.letters = dict(enumerate(byte_letters()))
        self.places: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes, self.key_bytes = array("I"), array("q"), array("q"), 0

    def held(self) -> int:
        """About how many bytes of memory the pieces take."""
        return 4 * len(self.pool) + 16 * len(self.starts) + self.key_bytes + 150 * len(self.places)

    def add(self, ids) -> int:
        """A new place for ids."""
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)
        return len(self.starts) - 1

    def keep(self, piece: bytes, ids) -> int:
        place = self.places[piece] = self.add(ids)
        self.key_bytes += len(piece)
        return place

    def cut_back(self, places: int) -> None:
        """Forgets the places from that number on."""
        if places < len(self.starts):
            del self.pool[self.starts[places] :], self.sizes[places:], self.starts[places:]

    def learn_words(self, words: list[bytes]) -> None:
        """Encodes what the library's own pattern takes for one word each; no word holds a line feed."""
        if not words:
            return
        written = b"\n".join(words).decode("latin-1").translate(self.letters | {10: "\n"}).split("\n")
        ids = [[t.id for t in tokens] for tokens in map(self.model.tokenize, written)]
        first = len(self.starts)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.starts.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.pool.extend(chain.from_iterable(ids))
        self.places.update(zip(words, range(first, first + len(words)), strict=True))
        self.key_bytes += sum(map(len, words))

    def ids(self, piece: bytes) -> array | list[int]:
        """The ids of a piece by its words."""
        text = piece.decode("utf-8", "replace")
        # Beyond Latin letters the two regex engines may know different Unicode versions.
        if max(text) >= "\u0250" or MARK in text or any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
            return self.whole(text)
        ids = array("I")
        for word in (w.encode() for w in self.pattern.findall(text)):
            if (at := self.places.get(word)) is None:
                at = self.keep(word, [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])
            ids += self.pool[self.starts[at] : self.starts[at] + self.sizes[at]]
        return ids

    def places_of(self, pieces: list[bytes]) -> tuple[np.ndarray, int]:
        """The place of each piece; those from the second value on are to be cut back after use."""
        found = list(map(self.places.get, pieces))
        new = [k for k, place in enumerate(found) if place is None]
        self.learn_words([pieces[k] for k in new if is_word(pieces[k])])
        long = []
        for k in new:
            piece = pieces[k]
            if (place := self.places.get(piece)) is not None:
                found[k] = place
            elif len(piece) > LONG_PIECE:
                long.append((k, self.ids(piece)))
            else:
                ids = self.ids(piece)  # which keeps the piece itself if it is one word
                found[k] = self.places[piece] if piece in self.places else self.keep(piece, ids)
        kept = len(self.starts)
        for k, ids in long:
            found[k] = self.add(ids)
        return np.array(found, dtype=np.int64), kept


def is_word(piece: bytes) -> bool:
    """Whether a piece is Latin letters only, with or without a space ahead: one word to every regex engine."""
    letters = piece.removeprefix(b" ")
    if letters.isalpha():  # for bytes, ASCII letters only
        return len(piece) <= LONG_PIECE
    text = letters.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and len(piece) <= LONG_PIECE


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending positions in the UTF-8 bytes of texts, which begin at `starts`, where pieces begin.

    A run of white space splits off all but its last character; a last space belongs to the word
    that follows, and at a text's end the run is one piece. Signs part from letters and digits
    before them. Runs next to odd white space aren't cut, nor are texts with a special token's mark.
    """
    kind = _CLASS[data]
    # The second bytes of the Latin-1 letters, all but the signs × and ÷ (no other character ends in C3 and such a byte).
    kind[1:][(data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = _WORD
    white = kind == _WHITE
    first, last = white.copy(), white.copy()
    first[1:] &= ~white[:-1]
    last[:-1] &= ~white[1:]
    last[starts[starts > 0] - 1] = False
    last[-1:] = False
    odd, marks = _odd(data)
    if len(odd):
        # Each run's first and last byte; a run between texts is cut there anyway.
        run_ends = white.copy()
        run_ends[:-1] &= ~white[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(run_ends)
        touched = np.isin(b + 1, odd[:, 0]) | np.isin(a, odd[:, 1])
        first[a[touched]] = False
        last[b[touched]] = False
    cut = first | last
    cut[1:] |= last[:-1] & (data[:-1] != 32)
    cut[1:] |= (kind[1:] == _SIGN) & (kind[:-1] == _WORD)
    for text in np.unique(np.searchsorted(starts, marks, side="right")) - 1:
        cut[starts[text] : starts[text + 1] if text + 1 < len(starts) else None] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def _odd(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each odd character, and the starts of special tokens' marks."""
    lead = np.flatnonzero(_LEAD[data])
    if not len(lead):
        return np.zeros((0, 2), dtype=np.int64), lead
    follow = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    spans, code = [], np.zeros(len(lead), dtype=np.uint32)
    for n, codes in enumerate(_CODES):
        code = (code << 8) | follow[lead + n]
        at = lead[np.isin(code, codes)]
        spans.append(np.stack([at, at + n + 1], axis=1))
    found = np.concatenate(spans)
    is_mark = data[found[:, 0]] == ord(MARK[0])
    return found[~is_mark], found[is_mark, 0]


class WordEncoder:
    """encode(texts) gives what Tokenizer.encode(text, add_special_tokens=False) gives for each."""

    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        self.tokenizer, self.max_bytes = Tokenizer.from_file(path), max_bytes
        self.forget()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.pieces = _Pieces(self.tokenizer.model, self.whole)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; null is empty."""
        data, ends = utf8(texts)
        starts = np.concatenate([[0], ends[:-1]])
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(ends), dtype=np.int64)
        at = cuts(data, np.unique(starts[starts < ends]))
        bounds = np.append(at, len(data)).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        if self.pieces.held() > self.max_bytes:
            self.forget()
        places, kept = self.pieces.places_of(cut.dictionary.to_pylist())
        # Views on the growing arrays must be gone before the next piece is added; indexing copies.
        own_start, own_size = (np.frombuffer(a, dtype=np.int64)[places] for a in (self.pieces.starts, self.pieces.sizes))
        codes = cut.indices.to_numpy()
        sizes = own_size[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(own_start[codes] - before[:-1], sizes) + np.arange(before[-1])
        ids = np.frombuffer(self.pieces.pool, dtype=np.uint32)[where] if len(where) else np.zeros(0, dtype=np.uint32)
        self.pieces.cut_back(kept)
        return ids, before[np.searchsorted(at, ends)] - before[np.searchsorted(at, starts)]


def utf8(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts one after the other, and where each text ends; null is empty."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return held, bounds[1:] - bounds[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    return WordEncoder(path)


def ranges(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of items whose sizes add up to about `most`; a larger item is a range of its own."""
    out, ends, start = [], np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append((start, stop))
        start = stop
    return out


def text_ranges(texts: pa.Array, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each."""
    return ranges(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), most)
