"""N-gram Jaccard join with MinHash banding.

Documents with equal sets of word shingles form one class. Every class has `depth` MinHash values in each of `trees` trees. Fixed banding
replaces an LSH forest: classes meet if they share the first values of some tree, as many as the target recall for pairs at the threshold
allows. Matching from whole labels down would end at the same length and meet the same pairs, since a longer shared
prefix includes the shorter one; the other values serve the signature check. Classes that meet are compared by their whole signatures;
those that may reach the threshold are linked to candidate components, and inside these all pairs are verified on the exact shingle sets, in blocks.
Only counts and the links of a spanning forest leave a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakline.llm.common import WORD, in_arrow, stored, whole_text
from peakline.llm.components import components
from peakline.llm.hashing import mixed, shingles, sorted_groups


@dataclass(frozen=True)
class Forest:
    """width: words of a shingle; threshold: least similarity; trees and depth of the forest; recall: target for pairs
    at the threshold; group: largest trie node whose members are compared by signature (larger ones are candidates as a whole);
    block: shingles that one side of a verification task holds, on average."""

    width: int = 5
    threshold: float = 0.8
    trees: int = 24
    depth: int = 8
    recall: float = 0.9999
    group: int = 4096
    block: int = 400_000

    def prefix(self) -> int:
        """The longest prefix that reaches the target recall."""
        depth = self.depth
        while depth > 1 and 1 - (1 - self.threshold**depth) ** self.trees < self.recall:
            depth -= 1
        return depth

    def doubt(self) -> float:
        """Signatures agreeing in a smaller share than this are too unlike: six standard deviations below the threshold."""
        return self.threshold - 6 * (self.threshold * (1 - self.threshold) / (self.trees * self.depth)) ** 0.5


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int(mixed(mixed(values).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(values))).view(np.int64)[0])


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, row, node, size, signature, prefixes): the shingle set's hash and size, a byte of every MinHash value, and the hash of
    the matched prefix in every tree. Texts without words are left out."""
    n, prefix = forest.trees * forest.depth, forest.prefix()
    salts = np.random.default_rng(7).integers(0, 2**64, (2, n), dtype=np.uint64)
    salts[1] |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                have = shingles(text, forest.width)
                if not len(have):
                    continue
                low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(have), 512):  # keeps the table of values small for long texts
                    np.minimum(low, ((have[at:at + 512, None] ^ salts[0]) * salts[1]).min(axis=0), out=low)
                label = mixed(low).reshape(forest.trees, forest.depth)
                hashed = np.arange(forest.trees, dtype=np.uint64)
                for d in range(prefix):
                    hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) ^ label[:, d])
                rows.append((doc, row, set_hash(have), len(have), label.ravel().astype(np.uint8).tobytes(), hashed.view(np.int64).tolist()))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "row", "node", "size", "signature", "prefixes"])

    return docs.transform(in_arrow, run, "doc_id long, row long, node long, size int, signature binary, prefixes array<long>")


def _alike(batches: Iterator[pa.RecordBatch], doubt: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect, in every trie node, the classes whose signatures may reach the threshold."""
    for group in sorted_groups(batches, ["key"]):
        nodes = group.column("node").to_numpy()
        bytes_ = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
        like_first = (bytes_ == bytes_[0]).mean(axis=1) >= doubt
        # All that are like the first are connected by it. Each of the others is compared with everyone.
        label = np.where(like_first, 0, np.arange(len(nodes)))
        for at in np.flatnonzero(~like_first):
            meets = np.unique(label[(bytes_ == bytes_[at]).mean(axis=1) >= doubt])
            if len(meets) > 1:
                label[np.isin(label, meets)] = meets[0]
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["a", "b"])


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[others]."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[name] > 1
    name, owner = name[shared], owner[shared]
    out = np.zeros((len(rows), len(others)), np.float32)
    if not len(name):
        return out
    names, name = np.unique(name, return_inverse=True)
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    step = max(256, 4_000_000 // len(sets))
    for low in range(0, len(names), step):
        a, b = np.searchsorted(name, [low, low + step])
        table = np.zeros((len(sets), min(step, len(names) - low)), np.float32)
        table[owner[a:b], name[a:b] - low] = 1
        out += table[rows] @ table[others].T
    return np.rint(out).astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For every pair of blocks of a component: (node, link, texts, docs): links of a spanning forest (counts 0), and how many other classes and
    documents each class is linked to (link null)."""
    for group in sorted_groups(batches, ["label", "one", "two"]):
        sets = [x.values.to_numpy() for x in group.column("shingles").combine_chunks()]
        nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)  # rows of one class may repeat
        sets = [sets[i] for i in first]
        blocks, copies = (group.column(c).to_numpy()[first] for c in ("block", "copies"))
        one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        size = np.array(list(map(len, sets)))
        rows = np.flatnonzero(blocks == one)
        others = rows if one == two else np.flatnonzero(blocks == two)
        if not len(rows) or not len(others):
            continue
        both = _overlaps(sets, rows, others)
        # Whole numbers on both sides: no rounding decides a pair.
        linked = both * 10_000 >= round(threshold * 10_000) * (size[rows][:, None] + size[others][None, :] - both)
        if one == two:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        counts = [(nodes[r], None, t, d) for r, t, d in zip(rows, linked.sum(axis=1).tolist(), (linked @ copies[others]).tolist(), strict=True) if t]
        if one != two:
            counts += [(nodes[o], None, t, d) for o, t, d in zip(others, linked.sum(axis=0).tolist(), (copies[rows] @ linked).tolist(), strict=True) if t]
        label = np.arange(len(nodes))
        for r, row in zip(rows, linked, strict=True):
            meets = np.unique(label[np.append(others[row], r)])
            if len(meets) > 1:
                label[np.isin(label, meets)] = meets[0]
        counts += [(nodes[i], nodes[label[i]], 0, 0) for i in np.flatnonzero(label != np.arange(len(nodes)))]
        columns = list(zip(*counts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "link", "texts", "docs"])


def join(docs: DataFrame, forest: Forest = Forest(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that are linked by a Jaccard similarity of at least the threshold, directly or in steps.

    Returns one row per row: doc_id, class_id (the smallest id of its class), n_links (other documents whose shingle set is similar
    enough, equal ones included) and n_text_links (other shingle sets among them). Shingles are windows of `width` words; a text of fewer words
    has one shingle of all of them; a null text or one without words has none, no links and a class of its own. Rows without an id are compared like all others; a
    class of such rows alone has no class_id. Ids are meant to be unique; different texts of one id are told apart by their texts.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    narrow = _rows(docs, id_col, text_col)
    linked = _classified(narrow, forest).select("doc_id", "class_id", "n_links", "n_text_links")
    none = F.lit(0).cast("long")
    empty = narrow.filter(~F.col("text").rlike(WORD)).select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_text_links"))
    return linked.unionByName(empty)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): a row is known by its id and text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return narrow.withColumn("row", F.xxhash64("doc_id", "text"))


def _classified(narrow: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, row, label, class_id, n_links, n_text_links) of every row with words; rows of one class have one label."""
    signed = stored(signatures(narrow, forest))
    same = stored(signed.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("prefixes").alias("prefixes")))
    checked = stored(verified(narrow, candidates(same, forest), same, forest))
    counts = checked.filter("link IS NULL").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = stored(components(checked.filter("link IS NOT NULL").select(F.col("node").alias("a"), F.col("link").alias("b"))))
    # A class is known by the smallest id of its documents.
    named = classes.join(same.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("class_id"))
    facts = (same.select("node", "doc", "copies").join(counts, "node", "left").join(classes, "node", "left").join(named, "label", "left")
             .select("node", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return signed.select("doc_id", "row", "node").join(facts, "node").drop("node")


def candidates(classes: DataFrame, forest: Forest) -> DataFrame:
    """(node, label): components of classes that meet in a trie node and whose signatures may reach the threshold."""
    places = classes.select("node", F.explode("prefixes").alias("key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    met = stored(places.join(shared, "key"))
    small = met.filter(F.col("n") <= forest.group).select("key", "node").join(classes.select("node", "signature"), "node")
    doubt = forest.doubt()
    near = small.repartition("key").sortWithinPartitions("key").transform(in_arrow, lambda batches: _alike(batches, doubt), "a long, b long")
    star = met.filter((F.col("n") > forest.group) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return stored(components(near.unionByName(star)))


def verified(docs: DataFrame, found: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """Exact comparison of all pairs inside every candidate component.

    Components are cut into blocks of about `forest.block` shingles by a hash of the node; a task compares two blocks, and a
    document is sent once for every block it is compared with.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(text, forest.width) for text in batch.column("text").to_pylist()]
            # Another text may share the hash of the class's row.
            right = pa.array([set_hash(v) == n for v, n in zip(values, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            table = [*(batch.column(c) for c in ("node", "label", "copies", "blocks")), pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(table, names=["node", "label", "copies", "blocks", "shingles"]).filter(right)

    sized = found.join(classes.select("node", "row", "size", "copies"), "node")
    blocks = sized.groupBy("label").agg(F.ceil(F.sum("size") / forest.block).cast("int").alias("blocks"))
    listed = stored(sized.join(blocks, "label").select("node", "row", "label", "copies", "blocks"))
    # The list grows with the corpus, so texts and list always meet by a shuffle, in the same way at every size.
    texts = docs.join(listed.hint("merge"), "row").select("node", "label", "copies", "blocks", "text")
    with_sets = texts.transform(in_arrow, sets, "node long, label long, copies long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("one"), F.greatest(other, F.col("block")).alias("two")))
    dealt = with_sets.withColumn("block", own).withColumn("pair", F.explode(pairs)).select("label", "pair.one", "pair.two", "node", "block", "copies", "shingles")
    spread = dealt.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two")
    threshold = forest.threshold
    return spread.transform(in_arrow, lambda batches: _verified(batches, threshold), "node long, link long, texts long, docs long")


#: A column that no table has.
_ROW = "_peakline_row"


def keep_one(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One document of every class, the one with the smallest id; documents without words stay. Columns as in `docs`.

    Rows are known by id and text, so of different texts under one id each is judged by itself, and rows without an id take part like others
    (one stays of a class that has no other). Of rows equal in both one stays.
    """
    narrow = _rows(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    chosen = _classified(narrow, forest).groupBy("label").agg(first).select("first.row")
    kept = chosen.unionByName(narrow.filter(~F.col("text").rlike(WORD)).select("row")).distinct().withColumnRenamed("row", _ROW)
    return (docs.withColumn(_ROW, F.xxhash64(F.col("doc_id").cast("long"), whole_text())).join(kept.hint("merge"), _ROW, "left_semi")
            .dropDuplicates([_ROW, "doc_id"]).drop(_ROW))


def sql(forest: Forest = Forest(), source: str = "documents") -> str:
    """The same classes and counts in DuckDB's SQL, by comparing all pairs that share a shingle."""
    n = forest.width
    window = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, n))])
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM {source}),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, ws FROM d),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, {window} AS sh FROM w WHERE n >= {n} WINDOW o AS (PARTITION BY doc_id ORDER BY p)
        UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {n - 1}) WHERE sh IS NOT NULL),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, (inter = x.size AND inter = y.size) AS equal FROM i JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE inter * 10000 >= {round(forest.threshold * 10000)} * (x.size + y.size - inter)),
r(doc, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT doc AS doc_id, min(seen) AS class_id FROM r GROUP BY doc),
e AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.b) FILTER (l.equal), d.doc_id)) AS same FROM d LEFT JOIN l ON l.a = d.doc_id GROUP BY d.doc_id),
k AS (SELECT l.a AS doc_id, count(*) AS n_links, count(DISTINCT e.same) FILTER (NOT l.equal) AS n_text_links FROM l JOIN e ON e.doc_id = l.b GROUP BY l.a)
SELECT c.doc_id, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(k.n_text_links, 0)::BIGINT AS n_text_links FROM c LEFT JOIN k USING (doc_id)"""
