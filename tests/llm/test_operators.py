"""The corpus operators on small tables with nulls, empty, long, repeated and odd texts, against brute force."""

import collections
import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakline.llm import (bpe, components, deep_shallow, hashing, imatch, jaccard_join, mixing, pii, quality_rules, ranking, repair,
                          sentencepiece_viterbi, suffix_dedup, token_counts)
from tests.llm import brute

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_id(df, *columns):
    out = collections.defaultdict(list)
    for row in df.collect():
        out[row["doc_id"]].append(tuple(row[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def library(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


# 1 -----------------------------------------------------------------------------------------------------------------

def test_mix_meets_targets(make):
    rng = random.Random(1)
    pairs = [(i, "w " * rng.randint(0, 60)) for i in range(600)]
    got = mixing.mix(make(pairs, ("a", "b", "c", "b", None)), (5.0, 2.0, 1.0)).toPandas()
    sizes = {s if isinstance(s, str) else None: int(n) for s, n in got.groupby("source", dropna=False)["size"].sum().items()}
    want = brute.mix_targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        size, target = want[source if isinstance(source, str) else None]
        assert set(part["source_size"]) == {size} and part["target"].iloc[0] == pytest.approx(target)
        assert abs(part["taken"].sum() - target) <= 2
    assert (got["taken"] <= 2 * got["size"]).all() and sorted(got["doc_id"]) == list(range(600))


def test_mix_rates_are_tilted(make):
    """Within a source the rates are min(2, exp(lambda * size / mean))."""
    got = mixing.mix(make([(i, "w " * (i + 1)) for i in range(40)], ("a", "b")), (3.0, 1.0)).toPandas()
    for _, part in got.groupby("source"):
        open_ = part[part["rate"] < 2 * (1 - 1e-9)]
        if not len(open_):  # its target is twice its size
            continue
        slope = np.log(open_["rate"]) / open_["size"]
        assert slope.max() - slope.min() < 1e-6 * max(1e-3, abs(slope).max())


def test_mix_edges(make, texts):
    docs = make(texts)
    got = mixing.mix(docs, (5.0, 2.0, 1.0))
    assert by_id(got, "taken") == by_id(mixing.mix(docs, (5.0, 2.0, 1.0)), "taken")  # reruns agree
    assert got.count() == len(texts) and got.filter("taken > 2 * size").count() == 0
    assert mixing.mix(make([]), (5.0,)).count() == 0
    assert [r["taken"] for r in mixing.mix(make([(1, None), (2, "")]), (5.0,)).collect()] == [0, 0]
    taken = mixing.take(docs, (5.0, 2.0, 1.0))
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got.collect())


def test_hot_cell_is_split(make, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 16)
    got = mixing.mix(make([(i, "same text of six words here") for i in range(500)] + [(1000 + i, "w " * 9) for i in range(50)], ("a",)), (1.0,), 1.3).toPandas()
    assert abs(got["taken"].sum() - got["target"].iloc[0]) < 0.1 * got["target"].iloc[0] and set(got["copies"]) <= {0, 1, 2}


# 2 -----------------------------------------------------------------------------------------------------------------

def test_jaccard_join(make, texts):
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(120)]
    more = []
    for i in range(40):  # a chain of near copies
        base = list(base)
        base[rng.randrange(len(base))] = str(rng.random())
        more.append((100 + i, " ".join(base)))
    pairs = [(i, t) for i, t in dict(texts).items() if i is not None] + more
    want = brute.jaccard_classes(pairs)
    got = by_id(jaccard_join.join(make(pairs)), "class_id", "n_links", "n_text_links")
    assert got == {i: [v] for i, v in want.items()}
    # Blocks and oversized trie nodes give the same.
    assert by_id(jaccard_join.join(make(pairs), jaccard_join.Forest(block=500, group=3)), "class_id", "n_links", "n_text_links") == got


def test_jaccard_edges(make, texts):
    docs = make(texts)
    got = by_id(jaccard_join.join(docs), "class_id", "n_links")
    assert got[1] == [(1, 2)] and got[6] == [(6, 0)] and got[8] == [(8, 0)] and got[9] == got[10] == [(9, 1)] and got[4] == [(4, 1), (4, 1)] and got[None] == [(None, 0)]
    assert jaccard_join.join(make([])).count() == 0
    kept = jaccard_join.keep_one(docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert kept.columns == docs.columns and ids == [(False, i) for i in (1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15)] + [(True, None)]


def test_jaccard_rows_without_ids_and_repeated_ids(make):
    """Links of rows without an id are found; a unique text under a repeated id is not lost, a near copy under one is not kept."""
    rng = random.Random(20)
    prose = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(120))
    a, b, c = prose(), prose(), prose()
    rows = [(None, a), (None, a), (None, a + " more"), (1, b), (3, b + " tail"), (3, c), (4, ""), (4, None), (None, "")]
    got = sorted(map(tuple, jaccard_join.join(make(rows)).collect()), key=str)
    assert got == sorted([(None, None, 2, 1), (None, None, 2, 1), (None, None, 2, 1), (1, 1, 1, 1), (3, 1, 1, 1), (3, 3, 0, 0), (4, 4, 0, 0), (4, 4, 0, 0), (None, None, 0, 0)], key=str)
    kept = jaccard_join.keep_one(make(rows)).collect()
    assert sum(r["doc_id"] is None and bool(r["text"]) for r in kept) == 1 and {(r["doc_id"], r["text"]) for r in kept if r["doc_id"]} >= {(1, b), (3, c)}
    assert not any(r["text"] == b + " tail" for r in kept) and set(kept[0].asDict()) == set(make([]).columns)


def test_jaccard_recall_near_the_threshold(make):
    """Planted pairs of similarity 0.80 to 0.85."""
    rng = random.Random(21)
    rows, pairs = [], 0
    for k in range(150):
        words = [f"v{rng.randint(0, 10**7)}" for _ in range(rng.choice([150, 300, 600]))]
        other = list(words)
        while len(brute.shingle_set(" ".join(words)) & brute.shingle_set(" ".join(other))) / len(brute.shingle_set(" ".join(words)) | brute.shingle_set(" ".join(other))) > 0.85:
            other[rng.randrange(len(other))] = f"x{rng.randint(0, 10**7)}"
        x, y = brute.shingle_set(" ".join(words)), brute.shingle_set(" ".join(other))
        if len(x & y) >= 0.8 * len(x | y):
            pairs += 1
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = jaccard_join.join(make(rows)).filter("n_links = 1").count() / 2
    assert pairs >= 60 and found >= 0.9 * pairs


def test_forest_recall():
    forest = jaccard_join.Forest()
    assert 1 - (1 - 0.8 ** forest.prefix()) ** forest.trees >= forest.recall and forest.prefix() < forest.depth


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# 3 -----------------------------------------------------------------------------------------------------------------

def test_token_counts(make, texts):
    lengths = sorted(len(library(t)) for _, t in texts)
    table = token_counts.limit_table(token_counts.length_histogram(token_counts.token_lengths(make(texts), BPE)))
    rows = table.collect()
    assert sorted(r["context_limit"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["context_limit"]
        assert (r["docs"], r["docs_over"], r["total_tokens"]) == (lengths.count(limit), sum(n > limit for n in lengths), sum(lengths))
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths) and r["tokens_within"] == sum(n for n in lengths if n <= limit)
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    limits = [0, 1, 7, 100, 10**6]
    assert [tuple(r) for r in token_counts.tokens_at(table, limits).orderBy("context_limit").collect()] == [(m, sum(min(n, m) for n in lengths), sum(n > m for n in lengths)) for m in limits]
    assert token_counts.quantile_length(table, 0.5) == lengths[(len(lengths) - 1) // 2]
    assert token_counts.limit_table(token_counts.length_histogram(token_counts.token_lengths(make([]), BPE))).count() == 0


def test_encoder_equals_library():
    rng = random.Random(6)
    parts = ["a", "B", "é", " ", "\n", "\t", "'s", "'", "!!", "$", "1", "23", "\xa0", "\x1c", "　", "  ", "<|endoftext|>", "😀", "the", " and", "'ll", "\r\n", "\x85", "\x00"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(BPE)
    got = bpe.Encoder(BPE).batch(some)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


# 4 -----------------------------------------------------------------------------------------------------------------

def test_imatch(make, texts):
    unique = {i: t for i, t in texts if i is not None}
    got = {r["doc_id"]: r for r in imatch.fingerprints(make(list(unique.items()))).collect()}
    order = sorted(unique, reverse=True)
    for k, i in enumerate(order):
        text, following = unique[i] or "", unique[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[2]["near_next"] == 1.0 and got[3]["near_next"] > 0.6 and got[5]["near_next"] < 0.9


def test_imatch_ranges_and_edges(spark, make, texts):
    docs = make(texts).select("doc_id", "text").fillna({"text": ""})
    small = imatch.with_next(docs, 500).collect()
    assert len({r["part"] for r in small}) > 3 and sum(r["copy"] == 0 for r in small) == len(texts)
    assert imatch.fingerprints(make(texts)).count() == len(texts)
    assert imatch.fingerprints(make([])).count() == 0
    assert imatch.fingerprints(make([(1, "alone here")])).first()["near_next"] == 1.0
    assert imatch.fingerprints(make([(None, "a"), (None, None)])).count() == 2


def test_likeness_estimates_overlap():
    terms = sorted(f"t{i}".encode() for i in range(2000))
    maker = imatch.Fingerprinter(terms)
    a, b = maker.of(" ".join(f"t{i}" for i in range(400))), maker.of(" ".join(f"t{i}" for i in range(200, 600)))
    stack = lambda p: (np.array([p[0]], np.uint64), p[1][None])
    assert 0.1 < imatch.likeness(*stack(a), *stack(b))[0] < 0.6 and imatch.likeness(*stack(a), *stack(a))[0] == 1.0


def test_imatch_near_copies_of_a_large_group(make):
    rng = random.Random(4)
    word = lambda k: f"{k}{rng.randint(0, 10**6)}"
    shared, others = [f"g{i}" for i in range(120)], [f"o{i}" for i in range(400)]
    # Ids 201 to 300 hold the group; every copy has a few edits, some of them band words. The others are strangers.
    copy = lambda: " ".join(rng.choice(others) if rng.random() < 0.03 else word("e") if rng.random() < 0.02 else w for w in shared)
    pairs = [(i, " ".join(rng.sample(others, 60))) for i in range(1, 201)] + [(i, copy()) for i in range(201, 301)]
    short = [(401, "rare1 rare2 rare3 rare4 rare5 rare6 rare7 rare8 rare9"), (400, "rare1 rare2 rare3 rare4 rare5 rare6 rare7 rare8 other9")]
    got = {r["doc_id"]: r for r in imatch.fingerprints(make(pairs + short)).collect()}
    assert not set(w.encode() for w in shared) & set(imatch.lexicon(make(pairs)))
    assert min(got[i]["near_next"] for i in range(202, 301)) > 0.5 and got[401]["near_next"] > 0.4
    assert max(got[i]["near_next"] for i in range(2, 201)) < 0.5 and got[201]["near_next"] < 0.3


def test_lexicon_is_bounded(make, texts):
    assert len(imatch.lexicon(make(texts), imatch.Band(0.0, 1.0, 50))) <= 50


# 5 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("group", [4000, 2])
def test_suffix_dedup(make, texts, group):
    rng = random.Random(8)
    line = "".join(rng.choice("abcd ") for _ in range(55))
    more = [(200 + i, "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 90))) + line[:rng.randint(20, 55)] + "".join(rng.choice("abcdefg ") for _ in range(60))) for i in range(60)]
    pairs = [*texts, *more]
    got = by_id(suffix_dedup.remove_repeats(make(pairs), 40, 10, group), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = collections.defaultdict(list)
    for (i, _), row in zip(pairs, brute.without_repeats([(t or "").encode() for _, t in pairs], 40), strict=True):
        want[i].append(row)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_repeats_are_measured_in_bytes(make):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    short, full = (prose(70).ljust(500)[:size - 1] + "#" for size in (399, 400))  # both of over 50 words
    assert min(len(x.split()) for x in (short, full)) > 50
    pairs = [(i, f"{prose(150)}!{i}{x}{i}!{prose(150)}") for i, x in enumerate([short, short, full, full, ""])]
    got = by_id(suffix_dedup.remove_repeats(make(pairs)), "n_bytes", "n_removed", "n_spans")
    assert got == {i: [(len(t), 400 if i in (2, 3) else 0, int(i in (2, 3)))] for i, t in pairs}


def test_a_large_group_meets_its_totals_in_many_tasks(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = [(7 if i % 2 else 1000 + i // 6, int(x), i) for i, x in enumerate(hashing.mixed(np.arange(12_000, dtype=np.uint64)).view(np.int64))] + [(-1, 5, 1), (8, -2, 1), (8, -2, 2)]
    want = collections.Counter(r[0] for r in rows)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        table = spark.createDataFrame(rows, "key long, around long, x long")
        got = suffix_dedup.with_totals(table, table, "key", "n").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["key"], r["around"], r["x"], r["n"]) for r in got) == sorted((*r, want[r[0]]) for r in rows if want[r[0]] > 1)
    in_task = collections.Counter(r["task"] for r in got if r["key"] == 7)
    assert sum(in_task.values()) == 6000 and max(in_task.values()) < 1500


def test_matching_starts_both_ways(monkeypatch):
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randint(3, 30)
        some = lambda size: bytes(rng.choice(b"ab") if rng.random() < 0.15 else 97 for _ in range(size))
        lefts, rights = [some(rng.choice([30, 30, 7, 0])) for _ in range(n)], [some(rng.choice([40, 40, 33])) for _ in range(n)]
        want = {(m, k) for m in range(n) for k in range(31) if any(o != m and lefts[o][:k] == lefts[m][:k] and rights[o][:40 - k] == rights[m][:40 - k]
                                                                  and min(len(lefts[m]), len(lefts[o])) >= k and min(len(rights[m]), len(rights[o])) >= 40 - k for o in range(n))}
        for paired in (64, 2):
            monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
            assert {(m, k) for m, low, high in suffix_dedup.matching_starts(lefts, rights, 40) for k in range(low, high + 1)} == want


def test_deep_shallow():
    rng = random.Random(9)
    for _ in range(300):
        letters = rng.choice([b"ab", b"a", b"abcdefgh\x00\xff"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.randint(1, 30))]
        for shallow in (1, 4, 100):
            order, lcp = deep_shallow.deep_shallow(strings, 0, shallow)
            assert [strings[i] for i in order] == sorted(strings)
            assert lcp[1:] == [next((k for k in range(min(len(strings[a]), len(strings[b]))) if strings[a][k] != strings[b][k]), min(len(strings[a]), len(strings[b]))) for a, b in zip(order, order[1:])]


def test_anchors_are_local():
    values = hashing.mixed(np.random.default_rng(1).integers(0, 50, 900).astype(np.uint64))
    got = suffix_dedup.anchors_of(values, 30)
    want = {j + min(range(30), key=lambda k, j=j: (int(values[j + k]) >> 30, k)) for j in range(900 - 29)}
    assert set(got.tolist()) == want


# 6 -----------------------------------------------------------------------------------------------------------------

def test_viterbi_is_best(texts):
    coder = sentencepiece_viterbi.Pieces(PIECES)
    pieces = {name: coder.automaton.get(name)[1] for name in coder.names if coder.automaton.exists(name)}
    rng = random.Random(10)
    some = [t for _, t in texts if t] + ["".join(rng.choice(["a", "B", "é", " ", "\n", "!!", "12", "  ", "😀", "the", " and", "漢"]) for _ in range(20)) for _ in range(200)]
    for text in (t[:400] for t in some):
        ids = np.frombuffer(coder.encode(text), "<u4")
        score, at = 0.0, 0
        while at < len(ids):
            if int(ids[at]) in coder.byte_of:  # a spelled character: its UTF-8 bytes
                first = coder.byte_of[int(ids[at])]
                at += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                score += coder.worst
            else:
                score += pieces[coder.names[ids[at]]]
                at += 1
        assert score == brute.best_score("▁" + text.replace(" ", "▁"), pieces, coder.worst)
        assert coder.decode(ids) == text


def test_sentencepiece_table(make, texts):
    got = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(make(texts), PIECES), PIECES)
    assert by_id(got, "text") == {i: sorted([((t or ""),)] * [x[0] for x in texts].count(i)) for i, t in texts}
    assert {r["n_tokens"] for r in got.filter("doc_id in (6, 7)").collect()} == {0}
    assert sentencepiece_viterbi.encode(make([]), PIECES).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------

def test_repair_grammar():
    rng = np.random.default_rng(11)
    for n, kinds in ((0, 5), (1, 5), (2, 1), (50, 1), (1000, 1), (5000, 3), (20000, 50), (3000, 50000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        rules, sequence = repair.compress(ids, 60000, least=2)
        lengths = repair.expansion_lengths(rules, 60000)
        assert (repair.expand(sequence, rules, 60000) == ids).all() and all(rules.max(axis=1, initial=0) < 60000 + np.arange(len(rules)))
        assert [len(repair.expand(np.array([60000 + i], np.uint32), rules, 60000)) for i in range(len(rules))] == lengths.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (repair.decode_range(rules, lengths, sequence, 60000, a, b) == ids[a:b]).all()
    assert len(repair.compress(np.tile(np.arange(9, dtype=np.uint32), 500), 60000)[1]) < 300


def test_repair_has_no_caps():
    """A passage of 1,000 ids that comes back is one symbol, and no pair is left that occurs often enough."""
    rng = np.random.default_rng(12)
    passage = rng.permutation(1000).astype(np.uint32)
    ids = np.concatenate([np.concatenate([passage, rng.integers(2000, 50000, 30).astype(np.uint32)]) for _ in range(6)])
    rules, sequence = repair.compress(ids, 60000)
    assert max(repair.expansion_lengths(rules, 60000)) >= 1000 and len(sequence) <= 6 * 31
    many = rng.zipf(1.3, 40000).astype(np.uint32) % 5000
    for least in (2, 4, 16):
        rules, sequence = repair.compress(many, 60000, least=least, rules_per_round=64)
        pairs = collections.Counter()
        for a, b, before in zip(sequence, sequence[1:], [None, *sequence], strict=False):
            pairs[a, b] += not a == b == before  # a stretch of one symbol counts every other pair
        assert max(pairs.values()) < 2 * least and (repair.expand(sequence, rules, 60000) == many).all()


def test_repair_work_follows_what_is_new(monkeypatch):
    """Distinct words are encoded once and their pairs counted once; decoding does not pass over all ids for every level of the grammar."""
    rng = random.Random(13)
    words = ["".join(rng.choice(["th", "er", "ñ", "ou", "é"]) for _ in range(4)) + rng.choice(["", ".", "***"]) for _ in range(300)]
    some = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)] + ["", "  odd\n\n12, <|endoftext|>"]
    encode, looked = bpe.Encoder(BPE), []
    whole = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    places = repair.with_end(encode.places(some), 0)
    ids = np.concatenate([[*t, 0] for t in whole]).astype(np.uint32)
    assert (bpe.gathered(places.ids, places.edges, places.which) == ids).all() and places.lengths().tolist() == [len(t) + 1 for t in whole]
    counted = repair._cells
    monkeypatch.setattr(repair, "_cells", lambda sequence, live, *more: looked.append(len(live)) or counted(sequence, live, *more))
    rules, sequence = repair.compress_places(places, 60000)
    assert (repair.expand(sequence, rules, 60000) == ids).all() and sum(looked) < 1.5 * len(ids)
    n = 2000
    chain = np.stack([np.concatenate([[1], 60000 + np.arange(n - 1)]), np.arange(n) + 1], axis=1).astype(np.uint32)
    flat = np.concatenate([np.zeros(300_000, np.uint32), [60000 + n - 1]])
    lengths, began = np.arange(n) + 2, time.process_time()
    assert (repair.expand(flat, chain, 60000, lengths)[300_000:] == [1, *range(1, n + 1)]).all() and time.process_time() - began < 1


def test_repair_files(spark, make, texts, tmp_path):
    pairs = sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]) + [x for x in texts if x[0] is None]
    path = str(tmp_path / "ids")
    repair.write_shards(make(texts), BPE, path)
    got = repair.checksums(repair.read_shards(spark, path)).orderBy("start").collect()
    start = 0
    for row, (i, text) in zip(got, pairs, strict=True):
        ids = [*library(text), 0]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.read_document(spark, path, 9).tolist() == [*library("two words"), 0] and repair.read_document(spark, path, 99) is None
    assert repair.round_trip(make([]), BPE, str(tmp_path / "none")).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------

def test_quality_rules(make, texts):
    duckdb = pytest.importorskip("duckdb")
    docs = make([*texts, (16, "Good line of prose with enough words to count here, it says.\n" * 3 + "All rights reserved.\nhome | about | news\n" + " ".join(f"w{i}" for i in range(70)) + ".")])
    got = quality_rules.judge(docs)
    plain = docs.select("doc_id", "text").toPandas()
    want = duckdb.connect().execute("WITH documents AS (SELECT * FROM plain) " + quality_rules.sql(select="*").replace("WITH d AS", ", d AS", 1)).df()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "n_lines_removed"]
    assert sorted(map(repr, got.select(*names).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want[names].itertuples(index=False, name=None))) and len(plain)
    facts = {r["doc_id"]: r for r in got.collect()}
    for i, text in texts:
        w = brute.words(text)
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p in range(len(w) - 2) if triples[tuple(w[p:p + 3])] > 1 for k in range(3)}
        assert (facts[i]["n_words"], facts[i]["word_chars"], facts[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
    assert facts[16]["kept"] and facts[16]["n_lines_removed"] == 2 and facts[1]["kept"] and not facts[13]["kept"] and not facts[14]["kept"] and not facts[6]["kept"]
    cleaned = quality_rules.clean(docs)
    assert cleaned.columns == docs.columns and "home |" not in {r["doc_id"]: r["text"] for r in cleaned.collect()}[16]
    assert quality_rules.judge(make([])).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------

def test_ranking(spark, make):
    rng = random.Random(12)
    good = lambda: "".join(" ".join("abcdefgh"[:rng.randint(2, 8)] for _ in range(rng.randint(8, 14))).capitalize() + ".\n" for _ in range(8))
    bad = lambda: " ".join(rng.choice(["###", "a$$$", "BUY!!", "x|"]) for _ in range(90))
    pairs = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (None, good())]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = ranking.classify(make(pairs), labels).collect()
    assert len(got) == len(pairs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert [r["score"] for r in ranking.classify(make(pairs[:4]), labels.limit(0)).collect()] == pytest.approx([0.3] * 4)
    assert ranking.classify(make([]), labels).count() == 0


def test_bradley_terry_recovers_order():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 3))
    better = x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.3 > 0
    fitted = ranking.fit_ranking(x, better)
    assert fitted.weights[0] > 0 > fitted.weights[1] and abs(fitted.weights[2]) < 0.3 * fitted.weights[0]


# 10 ----------------------------------------------------------------------------------------------------------------

PII_TEXTS = ["mail a.b+c@x-y.co.uk. and a@b.c@d.e x_y@z.w, @q.r a@b", "ips 1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111  1111", "+1 (555) 123-4567, +12 +49 30 123456 78 9 +1234567890123456",
             "call me on 030 1234567 or 555-123-4567 today, phone: 0171 2345678", "é😀 a@b.cd 😀 1.1.1.1", "date 2020-01-02 10 version 1.2.3 order 12345678", "joe (at) mail (dot) com", "1 " * 3000, "5" * 5000, "a." * 4000 + "@b.c", "x@a" + ".a" * 4000, "+1" + " 2" * 3000]


def test_pii(spark, make, texts):
    pairs = [*texts, *((300 + i, t) for i, t in enumerate(PII_TEXTS)), (400, "\n".join(PII_TEXTS))]
    got = {r["doc_id"]: r for r in pii.find(make(pairs)).withColumn("listed", pii.listed(pii.F.col("base"))).withColumn("all", pii.listed(pii.F.col("spans"))).collect()}
    for i, text in pairs:
        _, digest, listed = brute.pii(text)
        assert got[i]["listed"] == listed, (i, text and text[:80])
        assert set(filter(None, listed.split(","))) <= set(filter(None, got[i]["all"].split(",")))
    assert pii.find(make([])).count() == 0


def test_pii_adds_spans_near_context(make):
    spoken = [(i, f"please call phone +1 (555) 10{i % 10}-45{i % 7}0 now, or tel: 030 12{i % 10}4 567{i % 10} later") for i in range(60)] + [(100 + i, f"the number 12345{i % 10}78901 alone") for i in range(60)]
    got = by_id(pii.find(make(spoken)).withColumn("all", pii.listed(pii.F.col("spans"))), "all")
    assert all("id:" in got[i][0][0] for i in range(60)) and all(got[100 + i] == [("",)] for i in range(60))


NEIGHBOURS = ["pay 7536784127813050 4845168114407329 now", "ring +1 (826) 555-4081 190.137.223.204 today", "7536 7841 2781 3050 4845 1681 1440 7329"]


def test_pii_finds_numbers_side_by_side(make):
    row = " ".join(f"{i:05d}" for i in range(70001, 70013)) + " 7536784127813050 4845168114407329"
    got = by_id(pii.find(make([*enumerate(NEIGHBOURS), (5, row)])).withColumn("all", pii.listed(pii.F.col("spans"))), "all")
    spans = {i: v[0][0].split(",") for i, v in got.items()}
    assert spans[0] == ["id:4:20", "id:21:37"] and spans[1] == ["ip:23:38", "id:5:22"] and {"id:0:19", "id:20:39"} <= set(spans[2])
    assert {f"id:{row.index(n)}:{row.index(n) + 16}" for n in ("7536784127813050", "4845168114407329")} <= set(spans[5])


def test_pii_secrets_and_accounts(make):
    """Planted keys, passwords and accounts of seeded texts are found whole; hashes, paths, links, prose and broken check digits are left alone."""
    rng = __import__("random").Random(11)
    key = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted, clean = {}, {}
    for i in range(40):
        secret = [key(40), key(32, mixed) + "7aB1", "AKIA" + key(16, "ABCDEFGH0123456789"), "tr0ub4dor&3" + key(4)][i % 4]
        lead = ['token = "{}" ende', "api_key: {} und", "{} allein", "é😀 password={}\n"][i % 4]
        text = "some words before " + lead.format(secret) + " and behind"
        planted[i] = (text, f"secret:{text.index(secret)}:{text.index(secret) + len(secret)}")
        clean[100 + i] = [f"commit {key(40)} of the tree", "see src/main/java/com/example1/thing2 there", "at https://host.example/" + "a" * 3, "uncharacteristically internationalisation = good", f"sha256: {key(64)} file", "DE89 3704 0044 0532 0130 01 is wrong"][i % 6]
    planted[40] = ("pay to DE89 3704 0044 0532 0130 00, thanks", "iban:7:34")
    planted[41] = ("IBAN GB82WEST12345698765432", "iban:5:27")
    docs = make([*((i, t) for i, (t, _) in planted.items()), *clean.items(), (200, 'token = "'), (201, 'token = "' + "ab1" * 20000), (202, "=" * 5000 + "_" * 5000), (203, None)])
    got = {i: v[0][0].split(",") for i, v in by_id(pii.find(docs).withColumn("all", pii.listed(pii.F.col("spans"))), "all").items()}
    assert {i: want for i, (_, want) in planted.items() if want not in got[i]} == {}
    assert {i: got[i] for i in clean if any(s.startswith(("secret", "iban")) for s in got[i])} == {}
    assert got[200] == got[202] == got[203] == [""]
    masked = by_id(pii.mask(docs), "text")
    assert masked[0] == [('some words before token = "<SECRET>" ende and behind',)] and masked[40] == [("pay to <IBAN>, thanks",)]


def test_pii_fit_reports_reliabilities():
    model = pii.fit([((1, 1, 1, 0, 1), 50), ((0, 1, 1, 0, 1), 400), ((-1, -1, 1, 0, 1), 300), ((0, -1, -1, -1, 0), 900)], labelers=5)
    assert model.reliability[1] > (0.95, 0.95) and model.votes_for[1] > 1 and model.votes_against[1] < -1
    assert pii.fit([], labelers=5).bias < -5


def test_pii_mask(make):
    docs = make([(1, "to a@b.cd or 1.2.3.4, end"), (2, None), (3, "plain"), (4, "+1 (555) 123-4567"), (5, "")])
    got = pii.mask(docs)
    assert got.columns == docs.columns and by_id(got, "text", "n_chars") == {1: [("to <EMAIL> or <IP>, end", 23)], 2: [(None, None)], 3: [("plain", 5)], 4: [("<PHONE>", 7)], 5: [("", 0)]}


def test_pii_mask_side_by_side(make):
    got = by_id(pii.mask(make([*enumerate(NEIGHBOURS[:2])])), "text", "n_chars")
    assert got == {0: [("pay <ID> <ID> now", 17)], 1: [("ring <ID> <IP> today", 20)]}


# pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert docs.columns == first.columns, name
    end = corpus_pipeline.run(spark, sf)
    texts = by_id(docs, "text")
    decoded = sentencepiece_viterbi.decode(end, PIECES)
    assert by_id(decoded, "text") == texts and end.count() == docs.count() > 0
    kept = {r["doc_id"] for r in quality_rules.judge(first).filter("kept").collect()}
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, first, sf).collect()]
    firsts = {c for c, _, _ in brute.jaccard_classes(clean).values()}
    assert {i for i, _ in clean} == kept and set(texts) <= firsts and json.dumps(sorted(texts))
