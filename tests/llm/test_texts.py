"""Fill-in-the-middle, chat formatting and periodic runs on small tables, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from peakline.llm import chat_format as chat, fill_middle as fim, periodic_runs as runs

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
NUMBERS = "conv_id long, turn long, role string, text string, segment string, key int, ahead int"


# 11 ----------------------------------------------------------------------------------------------------------------

def plain_middle(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("unit", [None, r"\S+", r"[^\n]+"])
def test_skip_list_finds_every_rank(unit):
    rng = random.Random(1)
    for size in (0, 1, 15, 17, 400, 5000):
        text = "".join(rng.choice(["a", "é", "漢", "😀", " ", "\n"]) for _ in range(size))
        points, bytes_ = fim.unit_starts(text.encode(), unit)
        begins = [m.start() for m in re.finditer(unit or "(?s).", text)]
        begins = [*([0] * bool(begins)), *begins[1:], size]
        assert points.tolist() == begins
        units = fim.SkipList(points, bytes_)
        for rank in range(0, units.n + 1, 1 if size < 500 else 37):
            at = begins[rank]
            assert units.seek(rank) == (at, len(text[:at].encode()))
        if size == 5000 and unit is None:
            assert len(units.lanes) > 2


def test_fill_middle(make, texts):
    rows = [*texts, (20, "holds <P> inside"), (21, "holds <M"), (22, "S>P>M><S<P"), (23, "<"), (24, "<S"), (25, "🎉" * 3000)]
    rows += [(i, f"text number {i} <S " + "é" * (i % 7)) for i in range(100, 200)]
    docs = make(rows)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    got = fim.fill_middle(docs).select(*names, "output", fim.restored().alias("back")).collect()
    want = sorted(((i, *plain_middle(i, t), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in fim.digests(docs).collect()), key=str)
    assert digests == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=str)
    assert fim.fill_middle(make([])).count() == 0


def test_fill_middle_by_words(make):
    form = fim.Format(prefix="\x01", suffix="\x02", middle="\x03", share=100, suffix_first=50, seed=9, unit=r"\S+")
    text = "  one two  three\nfour "
    for r in fim.fill_middle(make([(i, text) for i in range(60)]), form).select("*", fim.restored(form).alias("back")).collect():
        assert r["back"] == text and r["n"] == 4
        cuts = {0, 6, 11, 17, len(text)}
        assert r["prefix_chars"] in cuts and r["prefix_chars"] + r["middle_chars"] in cuts


# 12 ----------------------------------------------------------------------------------------------------------------

def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        out[conv] = (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)), len(loss), sha(loss), len(chat.INSTRUCTION.render([m[1:] for m in mine])))
    return out


def conversations():
    rng = random.Random(3)
    bits = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "\\\\", "<s>", "<", "/s>", "é😀", "\n", "[TEXT]", "[ROLE]", "q", "z", "qq", " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]", None]), text()) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], text()) for t in range(500)]  # many segments
    rows += [(51, t * 1000 - 7000, "assistant", text()) for t in range(20)]  # gaps and negative numbers
    rows += [(52, None, "user", text()) for _ in range(70)] + [(52, 3, "assistant", "x")]  # without numbers
    rows += [(53, 1, "assistant", "same"), (53, 1, "assistant", "same"), (53, 1, "assistant", "other"), (53, 1, None, None)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), (54, 0, "assistant", "long " * 50_000), (55, 0, "user", "")]
    return [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_escape_is_reversible():
    rng = random.Random(4)
    bits = [*chat.CONTROLS, "\\", "<", ">", "[", "]", "/", "s", "INST", "a", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


@pytest.mark.parametrize("most", [chat.SEGMENT_CHARS, 40])
def test_chat_round_trip(spark, most, monkeypatch):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 7, None) for r in rows], NUMBERS)
    formatted = chat.format_conversations(table)
    if most < 1000:  # parts inside a segment
        parts = list(chat._formatted(iter([_batch(sorted((r for r in rows if r[0] == 50), key=lambda r: r[1]))]), chat.INSTRUCTION))
        assert "".join("".join(p.column("text").to_pylist()) for p in parts) == chat.INSTRUCTION.render([(r, x) for c, _, r, x in rows if c == 50])
        return
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.round_trip(table).collect()}
    assert got == plain_chat(rows)
    whole = {}
    for r in formatted.orderBy("segment", "part").collect():
        whole.setdefault(r["conv_id"], []).append(r)
    assert len(whole[50]) > 10 and len(whole[52]) > 2
    turns = [(r, x) for c, _, r, x in rows if c == 50]
    assert "".join(r["text"] for r in whole[50]) == chat.INSTRUCTION.render(turns)
    assert [r["text"][m["text_start"]:m["text_end"]] for r in whole[50] for m in r["turns"]] == [chat.escape(x) for _, x in turns]
    assert [m["loss"] for r in whole[50] for m in r["turns"]] == [r == "assistant" for r, _ in turns]
    assert chat.format_conversations(table.limit(0)).count() == 0 and chat.round_trip(table.limit(0)).count() == 0


def _batch(rows):
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    values = list(zip(*((c, 0, r, x, False) for c, _, r, x in rows), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["conv_id", "segment", "role", "text", "ahead"])


def _drops_thoughts(turns):
    """Keeps what an assistant thought only in the last turn."""
    return "".join(f"<{r}>{x if k == len(turns) - 1 else x.split('|')[-1]}</{r}>" for k, (r, x) in enumerate(turns))


def test_rewritten_history_is_detected(spark):
    turns = [("user", "hi"), ("assistant", "hm|yes"), ("user", "more"), ("assistant", "so|no")]
    found = chat.locate(chat.Template(_drops_thoughts, None, lambda x: x, local=False), [], turns)
    assert found.rewritten == [False, False, True, False]
    assert found.text == "<user>hi</user><assistant>yes</assistant><user>more</user><assistant>so|no</assistant>"
    # The first answer does not stand there as it was said, so it is not trained on.
    assert [s and found.text[s[0]:s[1]] for s in found.texts] == ["hi", None, "more", "so|no"]
    table = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(table, chat.Template(_drops_thoughts, None, lambda x: x, local=False)).collect()
    assert [m["loss"] for m in row["turns"]] == [False, False, False, True] and [m["rewritten"] for m in row["turns"]] == [False, False, True, False]
    with pytest.raises(Exception, match="not local"):
        chat.format_conversations(table, chat.Template(_drops_thoughts, None, lambda x: x)).collect()


def test_trimming_template_has_no_mask():
    """A template that strips texts: no span where the text was changed."""
    trims = chat.Template(lambda turns: "".join(f"<{r}>{x.strip()}</{r}>" for r, x in turns), None, lambda x: x)
    found = chat.locate(trims, [("user", "before")], [("user", "a"), ("assistant", " b "), ("assistant", "")])
    assert found.texts == [(6, 7), None, (49, 49)] and not any(found.rewritten)


# 13 ----------------------------------------------------------------------------------------------------------------

def plain_runs(words, exponent=4, least=6):
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any(i == s and j + q - i == m for s, m, _ in out):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc, words):
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def random_words(rng, n):
    out = []
    while len(out) < n:
        block = [rng.randint(0, 3) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))]
        out += block * rng.choice([1, 1, 2, 4, 7]) + block[:rng.randint(0, len(block))]
    return out[:n]


def test_grammar_extensions_are_exact():
    rng = random.Random(8)
    for n in (2, 3, 10, 60, 700):
        word = [100, *random_words(rng, n), 101]
        grammar = runs.Grammar(np.array(word), 102)
        pairs = [sorted(rng.sample(range(1, n + 1), 2)) for _ in range(300)]
        a, b = np.array(pairs).T
        ahead, back = grammar.extend(a, b, True), grammar.extend(a, b, False)
        for (i, j), x, y in zip(pairs, ahead.tolist(), back.tolist(), strict=True):
            k = m = 0
            while word[i + k] == word[j + k]:
                k += 1
            while word[i - m] == word[j - m]:
                m += 1
            assert (x, y) == (k, m)
        assert len(grammar.levels[-1].symbols) == 1


def test_runs_equal_plain_search():
    rng = random.Random(9)
    texts = [random_words(rng, rng.randint(0, 150)) for _ in range(250)] + [[], [1] * 5, [1] * 6, [1] * 400, [1, 2] * 3, [1, 2] * 4, [1, 1, 2] * 50 + [1], list(range(50)), [*range(7)] * 40]
    got = runs.runs_of_texts([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]
    got = runs.runs_of_texts([np.array(t, np.int64) for t in texts], 2, 2)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, 2, 2) for t in texts]


def test_candidates_in_several_rounds(monkeypatch):
    monkeypatch.setattr(runs, "BATCH_CANDIDATES", 50)
    test_runs_equal_plain_search()


def test_periodic_runs(make, texts, monkeypatch):
    rng = random.Random(10)
    some = [*texts, (60, "a b " * 40 + "\t\x0b c d  e"), (61, "é " * 6), (62, "x y z")]
    some += [(i, " ".join(f"w{k}" for k in random_words(rng, rng.randint(0, 90)))) for i in range(100, 260)]
    docs = make(some)
    monkeypatch.setattr(runs, "BATCH_WORDS", 500)
    found = runs.collapse(docs, runs.repeated_tail)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    want, lines = [], []
    for doc, text in some:
        words = edited(doc, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        mine = plain_runs(words)
        gone = {i for s, m, q in mine for i in range(s + q, s + m)}
        want.append((doc, len(words), mine, " ".join(w for i, w in enumerate(words) if i not in gone)))
        best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines.append((doc, len(mine), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in mine)), sha(want[-1][-1])))
    assert got == sorted(want, key=str)
    assert sorted((tuple(r) for r in runs.digests(found).collect()), key=str) == sorted(lines, key=str)
    assert sum(bool(w[2]) for w in want) > 50 and runs.digests(runs.collapse(make([]))).count() == 0
    assert any(edited(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) != re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in some)
