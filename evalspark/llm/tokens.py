"""Encoding with a tokenizers file, fast enough for corpora: each distinct pre-token is encoded once a worker.

Texts of ASCII and Latin-1 letters are cut into pre-tokens for many documents at once, on an array of byte classes; the
distinct pre-tokens go to the file's merge model, and their ids are copied to all places by gathers. Any other text is
cut at its spaces only, where the tokenizer itself always cuts, and its distinct words run through the whole tokenizer.
A worker's caches hold a bounded number of entries in two generations; what falls out is encoded again when it returns.
A text that may hold a special token is encoded whole.
"""

from __future__ import annotations

import operator
import os
import re
import struct
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Pre-tokens a worker keeps, in two generations; some 200 bytes each.
CACHE_ENTRIES = 400_000
#: Bytes of text that are cut at once; a larger text is cut alone.
GROUP_BYTES = 4 << 20
_SPACED = re.compile(r" (?=\S)")
#: A space and any white space: where neither occurs, splitting at spaces is splitting before each word.
_PAIRS = tuple(" " + chr(c) for c in range(0x3001) if chr(c).isspace())

SPACE, LETTER, DIGIT, MARK, LATIN_LEAD, TAIL, OTHER = range(7)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
for _k, _bytes in ((MARK, range(33, 127)), (SPACE, (9, 10, 11, 12, 13, 32)), (DIGIT, range(48, 58)), (LETTER, (*range(65, 91), *range(97, 123))), (TAIL, range(0x80, 0xC0)), (LATIN_LEAD, (0xC3,))):
    _CLASS[list(_bytes)] = _k
#: The two signs among the Latin-1 letters, by their second byte.
_TIMES, _DIVIDE = 0x97, 0xB7


def _byte_characters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others as characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters() | {0: "\0"}
_ID = operator.attrgetter("id")


class Generations:
    """A cache of two halves: when the young half is full it becomes the old one, and what is used again moves over."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def get_all(self, keys: list, learn: Callable[[list], list[bytes]]) -> list[bytes]:
        """Values of distinct ``keys``; ``learn`` gives those of the keys that neither half has."""
        young, old = self.young, self.old
        new = []
        for k in [k for k in keys if k not in young]:
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        young.update(zip(new, learn(new), strict=True))
        out = list(map(young.__getitem__, keys))
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out


def spread(flat: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + widths[i]]`` of all i in a row."""
    ends = np.cumsum(widths)
    at = np.repeat(starts - (ends - widths), widths)
    at += np.arange(len(at), dtype=at.dtype)
    return flat[at]


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of every byte of UTF-8 text; bytes of Latin-1 letters are letters, what needs more thought is OTHER."""
    kind = _CLASS[b]
    lead = np.flatnonzero(kind == LATIN_LEAD)
    if len(lead) or (kind == TAIL).any():
        second = b[lead + 1]
        good = (second != _TIMES) & (second != _DIVIDE)
        kind[lead] = np.where(good, LETTER, OTHER)
        kind[lead + 1] = np.where(good, LETTER, OTHER)
        kind[kind == TAIL] = OTHER
    return kind


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokens, self.words = Generations(cache_entries), Generations(cache_entries // 4)

    def cut(self, text: str) -> list:
        """The words of a text, as keys of the cache of words."""
        raise NotImplementedError

    def text_of(self, word) -> str:
        """What a key stands for in the text."""
        raise NotImplementedError

    def pre_tokens(self, b: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that lie in pre-tokens, where each pre-token begins among them, and where each document (``first``) does."""
        raise NotImplementedError

    def _learn_words(self, words: list) -> list[bytes]:
        out = []
        for i in range(0, len(words), 20_000):
            got = self.tokenizer.encode_batch_fast(list(map(self.text_of, words[i : i + 20_000])), add_special_tokens=False)
            out += [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in got]
        return out

    def _learn_tokens(self, tokens: list[bytes]) -> list[bytes]:
        if not tokens:
            return []
        shown = b"\0".join(tokens).decode("latin-1").translate(_BYTES).split("\0")  # a plain text holds no zero byte
        found = list(map(self.model.tokenize, shown))
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found))) * 4
        ids = np.fromiter(map(_ID, chain.from_iterable(found)), dtype="<u4", count=int(ends[-1]) >> 2).tobytes()
        ends = ends.tolist()
        return list(map(ids.__getitem__, map(slice, [0, *ends], ends)))

    def _encode_whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_odd(self, text: str) -> bytes:
        if "<|" in text:
            return self._encode_whole(text)
        words = self.cut(text)
        keys = list(dict.fromkeys(words))
        ids = dict(zip(keys, self.words.get_all(keys, self._learn_words), strict=True))
        return b"".join(map(ids.__getitem__, words))

    def _encode_group(self, texts: list[str], raw: list[bytes]) -> list[bytes]:
        """Ids of texts that are not empty."""
        import pyarrow as pa

        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        first = np.cumsum(sizes) - sizes
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        kind = byte_classes(b)
        odd = np.zeros(len(raw), dtype=bool)
        odd[np.searchsorted(first, np.flatnonzero(kind == OTHER), side="right") - 1] = True
        odd |= np.fromiter(("<|" in t for t in texts), dtype=bool, count=len(texts))
        if odd.any():
            plain = [i for i, o in enumerate(odd.tolist()) if not o]
            rest = iter(self._encode_group([texts[i] for i in plain], [raw[i] for i in plain]) if plain else [])
            return [self._encode_odd(t) if o else next(rest) for t, o in zip(texts, odd.tolist(), strict=True)]
        b, begin, first = self.pre_tokens(b, kind, first)
        if not len(begin):
            return [b""] * len(raw)
        offsets = np.append(begin, len(b)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(b)]).dictionary_encode()
        ids = self.tokens.get_all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn_tokens)
        width = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) >> 2
        start = np.cumsum(width, dtype=np.int32) - width
        index = coded.indices.to_numpy()
        width = width[index]
        flat = spread(np.frombuffer(b"".join(ids), dtype="<u4"), start[index], width)
        upto = np.append(0, np.cumsum(width, dtype=np.int64))
        edge = upto[np.searchsorted(begin, np.append(first, len(b)))].tolist()
        out = memoryview(flat.tobytes())
        return [bytes(out[4 * s : 4 * e]) for s, e in zip(edge[:-1], edge[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        some: list[int] = []
        raw: list[bytes] = []
        held = 0
        for i, t in enumerate(texts):
            if t:
                some.append(i)
                raw.append(t.encode())
                held += len(raw[-1])
            if some and (held >= GROUP_BYTES or i + 1 == len(texts)):
                for k, ids in zip(some, self._encode_group([texts[k] for k in some], raw), strict=True):
                    out[k] = ids
                some, raw, held = [], [], 0
        return out


def _contractions(b: np.ndarray, kind: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an apostrophe at which a pre-token begins (``alone``) opens one of the fixed endings, and the ending's length."""
    at = np.flatnonzero(alone)
    padded = np.append(b, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    length = np.zeros(len(at), dtype=np.int64)
    for end in (b"re", b"ve", b"ll"):
        length[(one == end[0]) & (two == end[1])] = 3
    length[np.isin(one, list(b"stmd"))] = 2
    return at[length > 0], length[length > 0]


class SpacedEncoder(Encoder):
    """Byte-level BPE: a space in front of a character that is no white space begins a word and belongs to it."""

    def pre_tokens(self, b: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins = np.empty(len(b), dtype=bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[first] = True
        # of white space before a word the last character is apart: a space goes to the word
        blank = kind == SPACE
        word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        starts = np.zeros(len(b), dtype=bool)
        starts[first] = True
        word = word[~starts[word]]
        begins[word - 1] = True
        begins[word[b[word - 1] == 32]] = False
        alone = (b == 39) & begins
        if alone.any():
            at, length = _contractions(b, kind, alone)
            end = at + length
            last = np.append(first[1:], len(b))[np.searchsorted(first, at, side="right") - 1]
            at, length, end = (x[end <= last] for x in (at, length, end))
            begins[at + 1] = False
            inner = end < len(b)
            begins[end[inner]] |= kind[end[inner]] != SPACE
            # white space after an ending keeps the cuts it has
        return b, np.flatnonzero(begins), first

    def cut(self, text: str) -> list[str]:
        words = text.split(" ") if not text.endswith(" ") and not any(p in text for p in _PAIRS) else _SPACED.split(text)
        if words[0]:
            words[0] = "\n" + words[0]  # no other word begins with white space: this one has no space in front
        else:
            del words[0]
        return words

    def text_of(self, word: str) -> str:
        return word[1:] if word[0] == "\n" else " " + word


class WordEncoder(Encoder):
    """BPE that lowers case and drops white space; keys are the lower-cased (ASCII) bytes of the words."""

    def pre_tokens(self, b: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = b.copy()
        b[(b >= 65) & (b <= 90)] += 32
        lead = np.flatnonzero(b == 0xC3)
        b[lead[b[lead + 1] <= 0x9E] + 1] += 32
        begins = np.empty(len(b), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[first] = True
        alone = (b == 39) & begins
        if alone.any():
            at, length = _contractions(b, kind, alone)
            last = np.append(first[1:], len(b))[np.searchsorted(first, at, side="right") - 1]
            at, length = at[at + length <= last], length[at + length <= last]
            begins[at + 1] = False
            end = at + length
            begins[end[end < len(b)]] = True
        keep = kind != SPACE
        before = np.append(0, np.cumsum(keep))
        return b[keep], np.flatnonzero(begins[keep]), before[first]

    def cut(self, text: str) -> list[bytes]:
        return text.encode().lower().split()

    def text_of(self, word: bytes) -> str:
        return word.decode()


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: type[Encoder]) -> Encoder:
    """One encoder a worker process and file."""
    key = (path, kind.__name__)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


def public_vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file; only queries use it, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)
