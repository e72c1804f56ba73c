"""SentencePiece encoding and decoding with the pieces and scores of a model file.

Encoding maximises the sum of piece scores (the unigram rule). An Aho-Corasick automaton over all pieces reads the text once; at every
position it follows its output links to each piece that ends there, and the best score up to that position is relaxed.
Characters that no piece covers are spelled as byte pieces. A piece holds the space mark only in front, or consists of marks alone,
so no piece crosses from another character to a mark: the text is cut there, and the pieces of a word are remembered per worker.

The models of /opt/tokenizers were made by merges, not by the unigram rule: their scores are merge ranks, so the ids are those
of the best-scoring segmentation, not those of the merge order. Decoding does not depend on the rule.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from peakline.llm.bpe import Known
from peakline.llm.common import in_arrow, whole_text

#: How SentencePiece writes a space. Fixed by the format.
MARK = "▁"
#: What an uncovered character costs below the worst piece. Fixed by the library's unigram rule.
UNKNOWN_PENALTY = 10.0
#: Bytes of words and ids remembered by one worker process, and texts encoded before their ids are handed over.
KEPT_BYTES, SLICE = 40_000_000, 512
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """The pieces of a model file, their automaton, and encoding and decoding of single texts."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes: dict[int, int] = {}
        self.control, self.unknown = set(), model.unk_id()
        self.automaton = ahocorasick.Automaton()
        worst = 0.0
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.control.add(i)
            else:
                score = float(np.float32(model.get_score(i)))
                worst = min(worst, score)
                self.automaton.add_word(name, (len(name), score, i))
        self.automaton.make_automaton()
        self.worst = worst - UNKNOWN_PENALTY
        # A piece with a mark behind another character would cross the places where texts are cut: such models are encoded whole.
        self.cuts = not any(MARK in name.lstrip(MARK) for i, name in enumerate(self.names) if i not in self.control)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.known = Known(KEPT_BYTES)

    def best(self, word: str) -> list[int]:
        """The best-scoring pieces of a string in which spaces are marks: one pass, a table of the best score and last
        piece for every position. Of equal scores the longest last piece stays, which the automaton reports first."""
        size, worst = len(word), self.worst
        score = [0.0, *[-math.inf] * size]
        start_of, piece_of = [0] * (size + 1), [-1] * (size + 1)
        done = 0  # positions up to here have all their pieces
        for last, (length, gain, piece) in self.automaton.iter(word):
            while done < last:
                done += 1  # the character before may also be spelled
                if score[done - 1] + worst > score[done]:
                    score[done], start_of[done], piece_of[done] = score[done - 1] + worst, done - 1, -1
            end = last + 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], start_of[end], piece_of[end] = total, end - length, piece
        while done < size:
            done += 1
            if score[done - 1] + worst > score[done]:
                score[done], start_of[done], piece_of[done] = score[done - 1] + worst, done - 1, -1
        ids, at = [], size
        while at:
            start, piece = start_of[at], piece_of[at]
            if piece < 0:
                ids += [self.bytes[b] for b in reversed(word[start:at].encode())] if self.bytes else [self.unknown]
            else:
                ids.append(piece)
            at = start
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids. A mark is put in front of a text that is not empty, as the model's rules say."""
        if not text:
            return b""
        if not self.cuts:
            return np.array(self.best(MARK + text.replace(" ", MARK)), "<u4").tobytes()
        known, words = self.known, text.split(" ")
        if MARK in text or "" in words:  # marks in a row: cut where another character goes before
            words = [word if word[0] != MARK or word[1:2] == MARK or len(word) == 1 else word[1:] for word in _WORDS.findall(MARK + text.replace(" ", MARK))]
        known.missed = missed = []
        ids = list(map(known.__getitem__, words))
        if missed:
            found: dict[str, bytes] = {}
            at = -1
            for _ in missed:
                at = ids.index(None, at + 1)
                word = words[at]
                if word not in found:
                    found[word] = np.array(self.best(word if word[0] == MARK else MARK + word), "<u4").tobytes()
                ids[at] = found[word]
            known.keep(found)
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are dropped, runs of byte ids are UTF-8 (undecodable bytes become U+FFFD), the mark put in front is removed."""
        out, raw = [], bytearray()
        names, byte_of = self.names, self.byte_of
        for i in ids.tolist():
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.control:
                out.append(names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of this worker process, made once and kept over tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, ids as little-endian uint32.

    A null or empty text has no ids. Repeated rows are encoded alike, other columns ignored whatever their names, an empty
    table gives an empty result. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            ids = [coder.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return narrow.transform(in_arrow, run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) from encoded rows. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            texts = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").transform(in_arrow, run, "doc_id long, n_tokens long, ids binary, text string")
