"""Byte-level BPE with the tokenizers library, a word at a time.

The tokenizer's pattern never lets a token cross from a character that is no white space to white space, so a
text may be cut there and its parts encoded alone. Arrow cuts the texts of a batch and finds their distinct words, of which each is looked up
once. Words repeat a lot between batches too: their ids are remembered per worker up
to a number of bytes; the rest, and words of more than KEPT_CHARS characters, are encoded again when they come.
"""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of words and ids remembered by one worker process, what an entry costs besides its characters and ids, and the longest word remembered.
KEPT_BYTES, ENTRY_BYTES, KEPT_CHARS = 100_000_000, 200, 64
#: Words encoded in one call of the library: many, but few enough for its working memory to stay in the processor's cache.
CALL_WORDS = 256
#: ASCII characters that the pattern puts into tokens of their own after a letter. Fixed by the pattern; the apostrophe is not among them.
MARKS = "#*$%&|<>!.,;:?()[]{}\"-+=/\\@^_~`"
_PLAIN = re.compile(r"\n?[^\W\d_]+")
#: White space of the tokenizer's pattern.
SPACE = "\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ANY_SPACE = re.compile(r"\s")
#: Marks a remembered piece that is not opened by one space or line break.
AS_IS = "\0"


class Places(NamedTuple):
    """Texts as places that hold pieces: the ids of all distinct pieces on end, where each begins and the last ends, the piece at every place, the number of places of each text."""

    ids: np.ndarray
    edges: np.ndarray
    which: np.ndarray
    counts: np.ndarray

    def lengths(self) -> np.ndarray:
        """Number of ids of every text."""
        total = np.concatenate([[0], np.cumsum(np.diff(self.edges)[self.which])])
        ends = np.cumsum(self.counts)
        return total[ends] - total[ends - self.counts]


def gathered(values: np.ndarray, edges: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches edges[w] to edges[w + 1] of `values` on end, for every w of `which`."""
    start, length = edges[:-1][which], np.diff(edges)[which]
    end = np.cumsum(length)
    return values[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def one_spaced(text: str) -> str | None:
    """A text with a space before every line break, if splitting it at single spaces then gives its words: neither white space in a row nor at an end,
    and no other white space or control character than these two."""
    lines = text.replace("\n", " \n")
    if "  " in lines or "\n " in lines or lines[:1] == " " or lines[-1:] in (" ", "\n") or not text.replace("\n", "").isprintable():
        return None
    return lines


def pieces(text: str) -> list[str]:
    """A text as a list of keys: "word" stands for " word", "\\nword" for itself, AS_IS + piece for any other piece.
    The first key is always of the last kind."""
    out = []
    for chunk in _CHUNKS.findall(text):
        single = len(chunk) > 1 and chunk[1] != AS_IS and not _ANY_SPACE.match(chunk, 1)
        if out and single and chunk[0] == " ":
            out.append(chunk[1:])
        elif out and single and chunk[0] == "\n":
            out.append(chunk)
        else:
            out.append(AS_IS + chunk)
    return out


class Known(dict):
    """Ids by key; a key that is not there gives None and is noted. Holds at most `room` bytes."""

    missed: list[str] = []

    def __init__(self, room: int):
        super().__init__()
        self.room = room

    def keep(self, found: dict[str, bytes]) -> None:
        """Remembers what there is room for. Characters count as one byte; wider ones are made up for by ENTRY_BYTES on the average word."""
        if self.room <= 0:
            return
        for key, ids in found.items():
            if len(key) <= KEPT_CHARS:
                self.room -= ENTRY_BYTES + len(key) + len(ids)
                if self.room <= 0:
                    return
                self[key] = ids

    def __missing__(self, key: str) -> None:
        self.missed.append(key)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(KEPT_BYTES)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = {" ": np.zeros(size, dtype=bool), "\n": np.zeros(size, dtype=bool)}
        for token, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[" "][at] = token.startswith("Ġ")  # how byte-level vocabularies write a space
            self.opens["\n"][at] = token.startswith("Ċ")
        self.special = [added.content for added in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _opened(self, words: list[str], opener: str) -> list[bytes]:
        """The ids of opener + word for words free of white space: one call, cut where a token begins with the opener."""
        ids = np.array(self.tokenizer.encode_batch_fast([opener + opener.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(self.opens[opener][ids])
        if len(starts) != len(words):
            return [self.whole(opener + word) for word in words]
        raw, starts = ids.tobytes(), (starts * 4).tolist()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new plain words, those opened by a line break apart from the others, a call for many; kept while there is room."""
        out: list[bytes] = []
        for broken, group in groupby(new, lambda word: word[0] == "\n"):
            words = list(group)
            for at in range(0, len(words), CALL_WORDS):
                part = words[at:at + CALL_WORDS]
                out += self._opened([word[1:] for word in part], "\n") if broken else self._opened(part, " ")
        if self.known.room > 0:
            self.known.keep(dict(zip(new, out, strict=True)))
        return out

    def _other(self, key: str) -> bytes:
        """Ids of a key that is no plain word with marks after it. Remembered behind a space, with which no key begins."""
        ids = self.known.get(" " + key)
        if ids is None:
            ids = self.whole(key[1:] if key[:1] == AS_IS else key if key[:1] == "\n" else " " + key)
            self.known.keep({" " + key: ids})
        return ids

    def _coded(self, keys: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, where each begins and the last ends) of distinct keys: those of the word and of the marks after it."""
        trimmed = pc.utf8_rtrim(keys, MARKS)
        n_marks = pc.binary_length(keys).to_numpy() - pc.binary_length(trimmed).to_numpy()
        coded = trimmed.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.known.get, words))
        holes = [i for i, found in enumerate(ids) if found is None]
        new = sorted((i for i in holes if words[i].isalpha() or _PLAIN.fullmatch(words[i])), key=lambda i: words[i][0] == "\n")
        for i, found in zip(new, self._learn([words[i] for i in new]), strict=True):
            ids[i] = found
        odd = np.zeros(len(ids), bool)
        for i in holes:
            if ids[i] is None:
                odd[i], ids[i] = True, b""
        # Marks come as further entries, none first; so do keys that are no such words, behind an empty one.
        number = {"": len(ids)}
        end_of = np.full(len(keys), len(ids))
        for mask, name in ((n_marks > 0) & ~odd[which], lambda key, n: key[-n:]), (odd[which], lambda key, n: AS_IS + key):
            at = np.flatnonzero(mask)
            ends = [name(key, n) for key, n in zip(keys.take(pa.array(at)).to_numpy(zero_copy_only=False), n_marks[at].tolist(), strict=True)]
            for end in dict.fromkeys(ends):
                number.setdefault(end, len(number) + len(words))
            end_of[at] = [number[end] for end in ends]
        ids += [self._other(end[1:]) if end[:1] == AS_IS else self.whole(end) for end in number]
        both = np.stack([which, end_of], axis=1)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        sizes = np.diff(edges)[both].sum(axis=1)
        return gathered(np.frombuffer(b"".join(ids), "<u4"), edges, both.ravel()), np.concatenate([[0], np.cumsum(sizes)])

    def places(self, texts: list[str]) -> Places:
        """The ids of every text, equal to what the library gives for the whole text."""
        parts = [pa.array([], pa.large_string())]
        counts = [np.zeros(0, np.int64)]
        special = [any(s in text for s in self.special) for text in texts]
        cut = [None if whole else one_spaced(text) for text, whole in zip(texts, special, strict=True)]
        for plain, group in groupby(range(len(texts)), lambda i: cut[i] is not None):
            if plain:
                words = pc.split_pattern(pa.array([AS_IS + cut[i] for i in group], pa.large_string()), " ")
                parts.append(words.values)
                counts.append(np.diff(words.offsets))
            else:
                keys = [[AS_IS + texts[i]] if special[i] else pieces(texts[i]) for i in group]
                parts.append(pa.array([key for some in keys for key in some], pa.large_string()))
                counts.append(np.array([len(some) for some in keys]))
        coded = pa.concat_arrays(parts).dictionary_encode()
        return Places(*self._coded(coded.dictionary), coded.indices.to_numpy(), np.concatenate(counts))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as bytes."""
        places = self.places(texts)
        raw, ends = gathered(*places[:3]).tobytes(), np.cumsum(places.lengths() * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, made once and kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
