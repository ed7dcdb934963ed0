"""Plain Python versions of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, found


def license_spans(text, rules):
    """Detections by rule on the words, resolved by containment: (start, end, label). No gates."""
    words, _ = license_base(text)
    flat = f" {' '.join(words)} " if words else "  "
    found = []
    for r in rules:
        found += [(flat[: m.start()].count(" ") - 1, flat[: m.start()].count(" ") + m[0].count(" "), r) for m in re.finditer(r.regex, flat)]

    def drops(e, d):
        if e[2].priority == 9 or not (e[0] <= d[0] and e[1] >= d[1]):
            return False
        return e[2].priority < d[2].priority or (e[2].priority == d[2].priority and (e[1] - e[0] > d[1] - d[0] or e[2].order < d[2].order))

    return [(a, b, r.label) for a, b, r in found if r.priority == 9 or not any(drops(e, (a, b, r)) for e in found)]


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols, caps = len(re.findall(r"[#*$%&|<>]", text)), sum(c.isupper() for c in text)
    chars = sum(map(len, w))
    share = lambda a, b: a * 1000 // b if b else 0
    rates = {"symbol_rate": share(symbols, chars), "repeat_rate": share(len(covered), len(w)), "line_rate": share(len(lines) - len(set(lines)), len(lines)), "capital_rate": share(caps, chars)}
    return (len(w), chars, symbols, len(lines) - len(set(lines)), len(covered)), rates


def quality_kept(docs, least_spread, fence, least_rows):
    """doc index -> kept, for (lang, source, text) rows."""
    every = [quality_counts(t) for _, _, t in docs]
    groups = defaultdict(list)
    for i, (lang, source, _) in enumerate(docs):
        for key in ((0, lang, source), (1, lang), (2,)):
            groups[key].append(i)

    def bin_of(v):
        return v if v < 64 else next((v >> k << k for k in range(1, 5) if v < 64 << k), 1024)

    def most(key, rate):
        v = sorted(bin_of(every[i][1][rate]) for i in groups[key])
        q = lambda p: v[max(0, math.ceil(p * len(v) / 100) - 1)]
        return q(75) + fence * max(q(75) - q(25), least_spread[rate])

    out = []
    for i, (lang, source, _) in enumerate(docs):
        key = next((k for k in ((0, lang, source), (1, lang)) if len(groups[k]) >= least_rows), (2,))
        (n, _, _, _, rep), rates = every[i]
        out.append(not (n < 50 or 100 * rep > 50 * n) and all(rates[r] <= most(key, r) for r in rates))
    return out


def mix_taken(docs, share=1.5, passes=2, weights=(3, 1, 2)):
    """Words taken of each of (doc_id, source, text) rows, by serving the queues in order of virtual time."""
    size = [len(WORD.findall(t or "")) for _, _, t in docs]
    names = sorted({s for _, s, _ in docs if s is not None}) + ([None] if any(s is None for _, s, _ in docs) else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(n for n, d in zip(size, docs) if d[1] == s) for s in names}
    # the level by bisection: at it the sources have sent the budget together
    low, high = 0.0, max((passes * total[s] / weight[s] for s in names), default=0.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(passes * total[s], weight[s] * mid) for s in names) < share * sum(size) else (low, mid)
    target = {s: min(passes * total[s], weight[s] * high) for s in names}
    taken = [0] * len(docs)
    for s in names:
        order = sorted((i for i, d in enumerate(docs) if d[1] == s), key=lambda i: (hashlib.md5(f"mix:{'' if docs[i][0] is None else docs[i][0]}".encode()).hexdigest(), docs[i][0] or 0, size[i]))
        left = math.floor(target[s] + 0.5 + 1e-9)
        for i in order * passes:
            n = min(size[i], left)
            taken[i] += n
            left -= n
    return size, target, taken


def fingerprint(text, k=3):
    w = WORD.findall(ascii_lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(docs, threshold=2):
    """(fingerprint, least id of the component) of each of (doc_id, text) rows, by comparing all pairs."""
    fps = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                root[find(b)] = find(a)
    least = {}
    for f, (d, _) in zip(fps, docs):
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(f, least.get(find(f))) for f in fps]


def shingle_set(t, k=5):
    """The word shingles of a text; none without a word."""
    w = WORD.findall(ascii_lower(t))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def jaccard(a, b, k=5):
    """Similarity of two texts by their sets of word shingles."""
    a, b = shingle_set(a, k), shingle_set(b, k)
    return len(a & b) / len(a | b) if a or b else 1.0


def nearest(rows, k, every):
    """(query, rank, id, score) for (id, vector) rows, by all products."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        found = []
        for i, b in fine:
            if i != q and len(a) == len(b):
                s = 0.0
                for x, y in zip(a, b):
                    s += x * y
                found += [(-s, i)] if s == s else []
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def segmented(text, v):
    """Ids by Viterbi over the whole text, character by character."""
    s = b" " + text.encode() if text else b""
    words = {}
    for i, p in enumerate(v.pieces):
        q = p.replace("▁".encode(), b" ")
        if i not in set(v.byte_ids.tolist()) and v.decoded[i] and b" " not in p and b" " not in q.lstrip(b" "):
            words.setdefault(q, i)
    n = len(s)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] == -math.inf:
            continue
        size, one = 1 if s[i] < 0xC0 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4, False
        for j in range(i + 1, min(n, i + 64) + 1):
            k = words.get(s[i:j])
            if k is not None:
                one |= j - i == size
                if best[i] + v.scores[k] > best[j]:
                    best[j], back[j] = best[i] + v.scores[k], (i, [k])
        if not one and best[i] + v.scores.min() - 10 > best[i + size]:
            best[i + size], back[i + size] = best[i] + v.scores.min() - 10, (i, [int(v.byte_ids[c]) for c in s[i : i + size]])
    out, j = [], n
    while j:
        i, ids = back[j]
        out, j = ids + out, i
    return out
