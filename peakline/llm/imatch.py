"""I-Match fingerprints.

Terms are words. The lexicon holds the terms whose document frequency lies in a band: common words and words of very few documents
say nothing about which text this is. A fingerprint is the hash of a text's sorted distinct lexicon terms, followed by hashes of the same list
restricted to randomised subsets of the lexicon. Subsets come at halving rates, so that a few terms of a text of any length fall
into some of them; the share of equal hashes at each rate then tells how many terms two texts differ in.

Copies count as documents, so the words of a large group of near copies leave the lexicon, and a short text may have no word in it. Membership
of a subset is a hash of the term alone, so every fingerprint also has the hashes over all distinct terms, and pairs in which a
text has too few lexicon terms are compared by those.

The lexicon is broadcast. Its size is bounded by a parameter: terms of at least Sum(distinct terms per document) / limit documents
cannot be more than the limit, and the band's lower edge is never below that.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakline.llm.common import TASK_BYTES, in_arrow, shipped, stored, whole_text

#: Rates 1/2, 1/4, ... of the lexicon subsets, and subsets per rate.
LEVELS, PER_LEVEL = 10, 6
SUBSETS = LEVELS * PER_LEVEL
_RATES = 0.5 ** np.arange(1, LEVELS + 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Distinct terms that a task counts before it passes the counts on, and terms outside the lexicon that a fingerprinter remembers.
COUNTED = 200_000
#: A text with a smaller share of lexicon terms among its distinct terms is compared by all of them.
LEAST_BAND_SHARE = 0.5


@dataclass(frozen=True)
class Band:
    """Terms of at least `least_share` and at most `most_share` of all documents, as document frequencies; `limit` bounds the lexicon."""

    least_share: float = 1 / 2000
    most_share: float = 0.2
    limit: int = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, docs): in how many documents each word occurs. Tasks count their own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "docs"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(set(text.encode().split()))  # bytes.split cuts at ASCII white space
                if len(counts) > COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(whole_text(text_col).alias("text")).transform(in_arrow, run, "term binary, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def lexicon(docs: DataFrame, band: Band = Band(), text_col: str = "text") -> list[bytes]:
    """The sorted terms of the band, at most band.limit of them."""
    counts = stored(document_frequencies(docs, text_col))
    n, terms = docs.count(), counts.agg(F.sum("docs")).first()[0] or 0
    least = max(n * band.least_share, terms / band.limit)
    return sorted(bytes(r[0]) for r in counts.filter(F.col("docs").between(math.ceil(least), max(1, math.floor(n * band.most_share)))).select("term").collect())


_SALTS = _mixed(np.array([(j + 1) * int(_ODD) % 2**64 for j in range(SUBSETS)], np.uint64))
_BELOW = np.array([2 ** (63 - j // PER_LEVEL) for j in range(SUBSETS)], np.uint64)


class Fingerprinter:
    """Fingerprints of texts by one lexicon; made once per task."""

    def __init__(self, terms: list[bytes]):
        self.place = {term: i for i, term in enumerate(terms)}
        self.known = len(terms)
        self.hash, self.member = np.zeros((2, self.known + COUNTED), np.uint64)
        self._note(terms, 0)

    def _note(self, terms: list[bytes], at: int) -> None:
        """Hashes of terms, and their subsets as bits, from row `at` on."""
        end = at + len(terms)
        if end > len(self.hash):  # a text of more terms than are remembered
            self.hash, self.member = (np.concatenate([x, np.zeros(end - len(x), np.uint64)]) for x in (self.hash, self.member))
        fresh = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in terms]), "<u8").astype(np.uint64)
        self.hash[at:end] = fresh
        for low in range(0, len(fresh), 4096):
            draws = _mixed(fresh[low:low + 4096, None] ^ _SALTS) < _BELOW
            self.member[at + low:at + low + len(draws)] = np.packbits(np.pad(draws, ((0, 0), (0, 64 - SUBSETS))), axis=1, bitorder="little").view("<u8")[:, 0]

    def _places(self, words: set[bytes]) -> np.ndarray:
        """Rows of the words; those outside the lexicon follow it, and are forgotten when they are many."""
        new = words.difference(self.place)
        if new and len(self.place) - self.known + len(new) > COUNTED:
            self.place = {t: i for t, i in self.place.items() if i < self.known}
            new = words.difference(self.place)
        if new:
            at = len(self.place)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            self._note(list(new), at)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(hash of all lexicon terms, hashes by subset of the lexicon terms and then of all terms, 0 where it holds none of the text's terms,
        and 1 if the lexicon terms are enough). A text with too few of them is told apart by the hash of all its terms."""
        at = self._places(set(text.encode().split()))
        band = at < self.known
        enough = int(band.sum()) >= max(1, LEAST_BAND_SHARE * len(at))
        value = np.empty((2, len(at)))
        value[1] = (self.hash[at] >> np.uint64(33)) + np.uint64(1)  # sums of 31 bits are exact in doubles
        value[0] = value[1] * band
        sums = np.zeros((2, SUBSETS), np.uint64)
        for low in range(0, len(at), 8192):
            bits = np.unpackbits(self.member[at[low:low + 8192]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += (value[:, low:low + 8192] @ bits[:, :SUBSETS].astype(np.float64)).astype(np.uint64)
        short = np.where(sums > 0, (_mixed(sums) % np.uint64(65535)).astype(np.uint16) + np.uint16(1), np.uint16(0))
        whole = _mixed(self.hash[at[band] if enough else at].sum(dtype=np.uint64, keepdims=True) ^ (np.uint64(0) if enough else _ODD))[0]
        return int(whole), np.append(short.ravel(), np.uint16(enough))


def printed(whole: int, subsets: np.ndarray) -> str:
    return f"{whole:016x}" + subsets.astype(">u2").tobytes().hex()


def _fitted(hits: np.ndarray) -> np.ndarray:
    """Maximum-likelihood x where hits[:, l] of PER_LEVEL trials had the chance exp(-rate_l * x). All hits: 0."""
    low, high = np.full(len(hits), -5.0), np.full(len(hits), 20.0)
    for _ in range(40):
        middle = (low + high) / 2
        e = np.exp(-_RATES * np.exp(middle)[:, None])
        slope = (_RATES * ((PER_LEVEL - hits) * e / np.maximum(1 - e, 1e-300) - hits)).sum(axis=1)
        low, high = np.where(slope > 0, middle, low), np.where(slope > 0, high, middle)
    return np.where((hits == PER_LEVEL).all(axis=1), 0.0, np.exp((low + high) / 2))


def likeness(whole_a: np.ndarray, a: np.ndarray, whole_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common terms of fingerprint pairs, 0 to 1: one minus terms in one text only by
    terms in either. Lexicon terms count if both texts have enough of them, else all terms. Equal full hashes give 1."""
    enough = ((a[:, -1] == 1) & (b[:, -1] == 1))[:, None]
    a, b = (np.where(enough, x[:, :SUBSETS], x[:, SUBSETS:2 * SUBSETS]) for x in (a, b))
    per = lambda x: x.reshape(len(x), LEVELS, PER_LEVEL).sum(axis=2)
    apart, either = _fitted(per(a == b)), _fitted(per((a == 0) & (b == 0)))
    share = np.where(either > 0, 1 - apart / np.maximum(either, 1e-9), 0.0)
    return np.where(whole_a == whole_b, 1.0, np.clip(share, 0.0, 1.0))


def with_next(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(part, copy, doc_id, text): the documents in ranges of descending id, null ids last, ties by text, so that a row's successor follows it.

    The first row of a range is repeated at the end of the range before it, and the first row of all at the end of the last (copy = 1).
    """
    size, n = docs.agg(F.sum(F.length("text")), F.count("doc_id")).first()
    parts = max(1, -(-(size or 0) // task_bytes))
    first = docs.agg(F.max("doc_id")).first()[0]
    starts = [] if not n else sorted({first, *docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}, reverse=True) if parts > 1 else [first]
    ups = np.array(sorted(int(s) for s in starts), np.int64)

    shipped(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """2 * part of a row, and 2 * part + 1 of the part that it also ends."""
        if not len(ups):
            return pd.Series([[0, 1]] * len(ids))
        null = ids.isna().to_numpy()
        value = ids.fillna(0).to_numpy().astype(np.int64)
        part = np.where(null, len(ups) - 1, len(ups) - 1 - np.searchsorted(ups, value, "left"))
        leads = ~null & (ups[np.minimum(np.searchsorted(ups, value, "left"), len(ups) - 1)] == value)
        return pd.Series([[2 * p, 2 * ((p or len(ups)) - 1) + 1] if lead else [2 * p] for p, lead in zip(part.tolist(), leads.tolist(), strict=True)])

    placed = docs.withColumn("place", F.explode(places("doc_id"))).select(F.floor(F.col("place") / 2).alias("part"), (F.col("place") % 2).alias("copy"), "doc_id", "text")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame, band: Band = Band(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    descending id order; the last document is followed by the first. Returns one row per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is empty. Rows of equal id follow each other by text, null ids come
    last. Other columns are ignored, whatever their names. A single document follows itself; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(narrow, band))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, before = fingerprinter(terms), None
        for batch in batches:
            rows = []
            for part, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")), strict=True):
                own = maker.of(text)
                if before is not None and before[0] == part and not before[1]:
                    _, _, before_doc, before_text, before_own = before
                    n = len(before_text)
                    edited = before_text[:n - n // 2] + text[:n // 2]
                    rows.append((before_doc, n, hashlib.sha256(edited.encode()).hexdigest(), before_own, maker.of(edited), own))
                before = (part, copy, doc, text, own)
            if rows:
                yield _answer(rows)

    return with_next(narrow).transform(in_arrow, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_MADE: dict[str, object] = {}


def fingerprinter(terms) -> Fingerprinter:
    """The fingerprinter of a broadcast lexicon; a worker keeps one."""
    value = terms.value
    if _MADE.get("of") is not value:
        _MADE.update(of=value, maker=Fingerprinter(value))
    return _MADE["maker"]


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, sha, own, edited, following = zip(*rows, strict=True)
    whole = lambda prints: np.array([p[0] for p in prints], np.uint64)
    subsets = lambda prints: np.stack([p[1] for p in prints])
    near = [likeness(whole(own), subsets(own), whole(other), subsets(other)) for other in (edited, following)]
    columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([printed(*p) for p in own]), pa.array([printed(*p) for p in edited]), *map(pa.array, near)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
