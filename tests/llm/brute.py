"""Plain single-machine versions of contract columns, for tests on small tables."""

import hashlib
import re


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    """{kind: [(start, end)]} and the digest of the exact spans."""
    text = text or ""
    size = lambda m: len(re.sub("[^0-9]", "", m))
    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= size(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= size(m) <= 15)}
    found = {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in rules.items()}
    listed = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return found, hashlib.sha256(listed.encode()).hexdigest(), listed


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: (source_size, target)} by raising the level in small steps of the sorted closing points."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, closed = share * sum(sizes.values()), {}
    while True:
        left = budget - sum(closed.values())
        open_ = [s for s in order if s not in closed]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return {s: (sizes[s], closed.get(s, weight[s] * level)) for s in order}
        closed |= {s: most * sizes[s] for s in over}


def shingle_set(text, n=5):
    w = words(text)
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def jaccard_classes(docs, threshold=0.8):
    """{id: (class_id, n_links, n_text_links)} for (id, text) by comparing everything."""
    sets = {i: frozenset(shingle_set(t)) for i, t in docs}
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            fresh = [k for k in links[todo.pop()] if k not in seen]
            seen.update(fresh)
            todo += fresh
        out[i] = (min(seen), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]}))
    return out


def without_repeats(texts, length):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] of byte strings."""
    count = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            count[t[p:p + length]] = count.get(t[p:p + length], 0) + 1
    out = []
    for t in texts:
        gone = [any(count[t[p:p + length]] > 1 for p in range(max(0, at - length + 1), min(at, len(t) - length) + 1)) for at in range(len(t))]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def best_score(text, pieces, worst):
    """Score of the best segmentation by trying every piece at every position. pieces: {piece: score}."""
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, pieces))
    for end in range(1, len(text) + 1):
        best[end] = max([best[end - 1] + worst, *(best[s] + pieces[text[s:end]] for s in range(max(0, end - longest), end) if text[s:end] in pieces)])
    return best[-1]
