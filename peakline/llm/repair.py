"""Token ids in a binary format compressed by a Re-Pair grammar, shard by shard.

A shard holds the ids of consecutive documents. Rounds of pair replacement turn frequent neighbouring symbols into a
nonterminal; a round replaces all pairs above a count at once, the most frequent first where they overlap, and the count
is lowered between rounds. Stored per shard: the rules of every round, the length of every nonterminal's expansion, the remaining sequence
and where each document begins, so one document can be decoded from its stretch of the sequence alone.

File format: a Parquet table with one row per shard. `rules` holds little-endian uint32 pairs (left, right), rule i defines the
symbol `base + i`; `lengths` the expansion lengths as uint32; `sequence` the symbols as uint32; `starts` the first id of every document inside the shard
as uint64, with the shard's id count at the end; `doc_ids` the ids of the documents as int64; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from peakline.llm.bpe import Places, encoder, gathered
from peakline.llm.common import TASK_BYTES, in_arrow, whole_text

#: The count below which a pair is left (a rule costs two symbols, so rarer pairs save next to nothing), and about how many rules a round adds.
LEAST_COUNT, RULES_PER_ROUND = 4, 16384
#: Pairs are counted in 2 ** CELL_BITS cells, or exactly at so many places or fewer.
CELL_BITS, EXACT_PLACES = 20, 1 << 17
#: Bytes of text with which a shard is closed, though its range goes on.
SHARD_BYTES = 3 * TASK_BYTES // 2
#: Shards whose offsets (two numbers each) may be broadcast; with more, the join shuffles.
BROADCAST_SHARDS = 500_000
SHARD_SCHEMA = "shard long, base long, n_ids long, doc_ids array<long>, starts binary, rules binary, lengths binary, sequence binary"


def compress(ids: np.ndarray, base: int, least: int = LEAST_COUNT, rules_per_round: int = RULES_PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence) of a grammar for `ids`, all below `base`. Rules are rows (left, right) of earlier symbols. Rounds
    go on until no pair occurs `least` times; `rules_per_round` only orders the work, frequent pairs first.
    """
    rules = [np.zeros((0, 2), np.uint32)]
    sequence, _ = _rounds(ids.astype(np.uint32), rules, base, least, rules_per_round)
    return np.concatenate(rules), sequence


def compress_places(places: Places, base: int, least: int = LEAST_COUNT, rules_per_round: int = RULES_PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """As `compress`, for the ids of all places. Pairs inside pieces are replaced first, in each distinct piece once, counted as often as it
    stands; then those across pieces, with whatever is left inside."""
    rules, n = [np.zeros((0, 2), np.uint32)], len(places.edges) - 1
    owner, often = np.repeat(np.arange(n, dtype=np.int32), np.diff(places.edges)), np.bincount(places.which, minlength=n).astype(float)
    pieces, owner = _rounds(places.ids.astype(np.uint32), rules, base, least, rules_per_round, owner, often)
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    sequence, _ = _rounds(gathered(pieces, edges, places.which), rules, base, least, rules_per_round)
    return np.concatenate(rules), sequence


def _rounds(sequence: np.ndarray, rules: list[np.ndarray], base: int, least: int, most: int, owner: np.ndarray | None = None,
            often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Rounds of pair replacement, which append to `rules`; what is left of `sequence` and `owner`. With `owner`, a number for every place, pairs are replaced between places
    of one owner only and count often[owner] times each.

    Pairs are counted in hash cells; a busy cell stands for one pair of its own, whose exact count decides, and a pair that shares its cell with another waits for the next
    round, which hashes differently. With few places to look at, and after a round that finds none, all pairs are counted exactly. Where chosen pairs overlap,
    the more frequent one is replaced; of a run of equal pairs every other one is. A pair too rare once stays so, as replacements only take from
    it: later rounds look at the others (`live`) and at pairs with a new symbol.
    """
    live, round_, exactly = np.arange(len(sequence) - 1), 0, False
    if owner is not None:
        live = live[owner[:-1] == owner[1:]]
    while len(live):
        weight = None if owner is None else often[owner[live]]
        exactly = exactly or len(live) <= EXACT_PLACES
        live, at, which, of, exact = (_all_pairs if exactly else _pairs_of_cells)(sequence, live, weight, least, most, round_)
        round_ += 1
        rank = np.empty(len(of), np.int64)
        rank[np.argsort(-exact, kind="stable")] = np.arange(len(of))
        place = rank[which]
        near = np.diff(at) == 1
        tie = (place[:-1] == place[1:]) & near
        lost = np.zeros(len(at), bool)
        if tie.any():
            # Of a pair on end every other one gives way, counted from where that stretch begins.
            here = np.arange(len(at))
            lost = (here - np.maximum.accumulate(np.where(np.concatenate([[True], ~tie]), here, 0))) & 1 == 1
        lost[1:] |= near & (place[1:] > place[:-1])
        lost[:-1] |= near & (place[:-1] > place[1:])
        at, which = at[~lost], which[~lost]
        used = np.bincount(which, None if owner is None else often[owner[at]], minlength=len(of)) >= 2
        at, which = at[used[which]], which[used[which]]
        if not len(at):
            if exactly:
                break
            exactly = True
            continue
        exactly = False
        symbol = np.cumsum(used) - 1 + base + sum(map(len, rules))
        rules.append(of[used])
        sequence[at] = symbol[which].astype(np.uint32)
        look, stay = np.zeros(len(sequence), bool), np.ones(len(sequence), bool)
        look[live] = look[at] = look[np.maximum(at - 1, 0)] = True
        stay[at + 1] = False
        sequence, live = sequence[stay], np.flatnonzero(look[stay])
        live = live[live < len(sequence) - 1]
        if owner is not None:
            owner = owner[stay]
            live = live[owner[live] == owner[live + 1]]
    return sequence, owner


def _cells(sequence: np.ndarray, live: np.ndarray, weight: np.ndarray | None, least: int, round_: int) -> tuple[np.ndarray, ...]:
    """(live, left, right, weight, cell) of the places whose pair may occur `least` times, and the count of every hash cell."""
    left, right = (sequence[:-1], sequence[1:]) if len(live) == len(sequence) - 1 else (sequence[live], sequence[live + 1])
    cell = (left * np.uint32(2654435761 + 8 * round_ & 0xFFFFFFFF)) ^ (right * np.uint32(2246822519 + 8 * round_ & 0xFFFFFFFF))  # wraps on purpose
    bits = min(CELL_BITS, 1 + len(live).bit_length())
    cell >>= np.uint32(32 - bits)
    count = np.bincount(cell, weight, minlength=1 << bits)
    may = np.flatnonzero((count >= least)[cell])
    return live[may], left[may], right[may], None if weight is None else weight[may], cell[may], count


def _pairs_of_cells(sequence: np.ndarray, live: np.ndarray, weight: np.ndarray | None, least: int, most: int, round_: int) -> tuple[np.ndarray, ...]:
    """(places still live, places, number of the pair there, pairs, their counts): of each of the about `most` fullest cells one pair, if it occurs `least` times."""
    live, left, right, weight, cell, count = _cells(sequence, live, weight, least, round_)
    busy = np.flatnonzero(count >= max(least, int(np.partition(count, -most)[-most])))
    index = np.full(len(count), -1, np.int32)
    index[busy] = np.arange(len(busy), dtype=np.int32)
    which = index[cell]
    at = np.flatnonzero(which >= 0)
    which, a, b = which[at], left[at], right[at]
    of = np.zeros((len(busy), 2), np.uint32)
    of[which, 0] = a
    of[which, 1] = b
    same = np.flatnonzero((of[which, 0] == a) & (of[which, 1] == b))
    at, which = at[same], which[same]
    exact = np.bincount(which, None if weight is None else weight[at], minlength=len(of))
    chosen = (exact >= least)[which]
    return live, live[at[chosen]], which[chosen], of, exact


def _all_pairs(sequence: np.ndarray, live: np.ndarray, weight: np.ndarray | None, least: int, most: int, round_: int) -> tuple[np.ndarray, ...]:
    """As `_pairs_of_cells`, with all pairs that occur `least` times: none of them is in an emptier cell."""
    live, left, right, weight, *_ = _cells(sequence, live, weight, least, round_)
    values, which = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_inverse=True)
    exact = np.bincount(which, weight, minlength=len(values))
    keep = exact >= least
    number = np.cumsum(keep) - 1
    may = np.flatnonzero(keep[which])
    values = values[keep]
    return live[may], live[may], number[which[may]], np.stack([values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), exact[keep]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each rule stands for. Rules refer only to earlier ones, which a pass by depth uses."""
    lengths = np.zeros(len(rules), np.int64)
    of = lambda s: np.where(s < base, 1, lengths[np.maximum(s.astype(np.int64) - base, 0)])
    open_ = np.arange(len(rules))
    while len(open_):
        total = of(rules[open_, 0]) * 1, of(rules[open_, 1]) * 1
        ready = (total[0] > 0) & (total[1] > 0)
        lengths[open_[ready]] = (total[0] + total[1])[ready]
        open_ = open_[~ready]
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that a stretch of symbols stands for. The rules' lengths say where the right part of a symbol begins, so each part goes to its place at once and
    only what is still open is looked at again, level by level."""
    lengths = expansion_lengths(rules, base) if lengths is None else lengths
    symbols, size = symbols.astype(np.uint32), _sizes(symbols, lengths, base)
    open_ = np.flatnonzero(symbols >= base)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    out[place] = symbols
    at, rule = place[open_], symbols[open_].astype(np.int64) - base
    left, right = np.ascontiguousarray(rules[:, 0]), np.ascontiguousarray(rules[:, 1])
    ahead = _sizes(left, lengths, base)
    while len(at):
        a, b, next_ = left[rule], right[rule], at + ahead[rule]
        out[at], out[next_] = a, b
        one, other = np.flatnonzero(a >= base), np.flatnonzero(b >= base)
        at, rule = np.concatenate([at[one], next_[other]]), np.concatenate([a[one], b[other]]).astype(np.int64) - base
    return out


def _sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each symbol stands for."""
    size = np.ones(len(symbols), np.int64)
    open_ = np.flatnonzero(symbols >= base)
    size[open_] = lengths[symbols[open_].astype(np.int64) - base]
    return size


def decode_range(rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, base: int, start: int, end: int) -> np.ndarray:
    """ids[start:end] of a shard: only the symbols that reach into the range are expanded."""
    edge = np.concatenate([[0], np.cumsum(_sizes(sequence, lengths, base))])
    first, last = np.searchsorted(edge, start, "right") - 1, np.searchsorted(edge, end, "left")
    return expand(sequence[first:last], rules, base, lengths)[start - edge[first]:end - edge[first]]


def with_end(places: Places, end_id: int) -> Places:
    """The same texts, each with one more id."""
    which = np.insert(places.which, np.cumsum(places.counts), len(places.edges) - 1)
    return Places(np.append(places.ids, np.uint32(end_id)), np.append(places.edges, places.edges[-1] + 1), which, places.counts + 1)


def write_shards(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents in ascending id order, null ids last, and write one row per shard to `path`.

    A shard is a range of ids of about TASK_BYTES of text; every document ends with `end_id`. A null or empty text has that id only. Documents of
    equal id follow each other in the order of their texts. Other columns are ignored; an empty table gives an empty file.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    null = F.col("doc_id").isNull()
    placed = narrow.withColumn("last", null).repartitionByRange(max(1, -(-size // TASK_BYTES)), "last", "doc_id").sortWithinPartitions("last", "doc_id", "text").drop("last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        base = max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        texts: list[str] = []
        ids: list[int | None] = []
        held, shard = 0, TaskContext.get().partitionId() << 24

        def close() -> pa.RecordBatch:
            places = with_end(encode.places(texts), end_id)
            starts = np.concatenate([[0], np.cumsum(places.lengths())])
            rules, sequence = compress_places(places, base)
            values = [shard, base, int(starts[-1]), ids, starts.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), sequence.astype("<u4").tobytes()]
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "base", "n_ids", "doc_ids", "starts", "rules", "lengths", "sequence"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts += part.column("text").to_pylist()
                ids += part.column("doc_id").to_pylist()
                held += pc.sum(pc.binary_length(part.column("text"))).as_py()
                if held >= SHARD_BYTES:  # a crowded range becomes several shards
                    yield close()
                    texts, ids, held, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    placed.transform(in_arrow, run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file: doc_id, start (ids of all documents before it), n_tokens, and their ids as little-endian uint32 in `ids`."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One number per shard; the window sees shards, not documents. The shards themselves stay where they are while that table is small.
    before = shards.select("shard", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if before.count() <= BROADCAST_SHARDS:
        before = F.broadcast(before)
    return shards.join(before, "shard").transform(in_arrow, _decoded, "doc_id long, start long, n_tokens long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            base, before, docs = get("base"), get("before"), get("doc_ids")
            rules = np.frombuffer(get("rules"), "<u4").reshape(-1, 2)
            sequence, starts = np.frombuffer(get("sequence"), "<u4"), np.frombuffer(get("starts"), "<u8").astype(np.int64)
            ids = expand(sequence, rules, base, np.frombuffer(get("lengths"), "<u4").astype(np.int64)).astype("<u4", copy=False)
            for at in range(0, len(docs), 512):
                to = min(at + 512, len(docs))
                edges = starts[at:to + 1]
                raw = ids[int(edges[0]):int(edges[-1])].tobytes()
                cut = ((edges - edges[0]) * 4).tolist()
                parts = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at:to], pa.int64()), pa.array(edges[:-1] + before), pa.array(np.diff(edges)), pa.array(parts, pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by its stretch of the sequence alone; None if the file does not hold it."""
    row = spark.read.schema(SHARD_SCHEMA).parquet(path).filter(F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        return None
    at = row["doc_ids"].index(doc_id)
    starts = np.frombuffer(row["starts"], "<u8")
    return decode_range(np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["sequence"], "<u4"),
                        row["base"], int(starts[at]), int(starts[at + 1]))


def checksums(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, unsigned."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    write_shards(docs, tokenizer, path)
    return checksums(read_shards(docs.sparkSession, path))

