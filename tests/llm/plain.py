"""Brute-force versions of the operators in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    text, out = text or "", []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items, window=10):
    words, hit, names = bench_words(text), set(), set()
    for name, item in items:
        own = bench_words(item)
        n = min(window, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit.update(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = {}
    for i in range(len(words) - 4):
        wins.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeat = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(words) < 10 or 100 * len(repeat) > 20 * len(words))


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    n = min(width, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def classes(rows, width, percent):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def importance(docs, items, percent=5, min_words=20, buckets=10_000, seed=42):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows; item texts are the target."""
    def runs(text):
        ws = bench_words(text)
        return [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(ws) - n + 1)], len(ws)

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(runs(text)[0])
    for text in items:
        t.update(runs(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        found, n = runs(text)
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def whitened(vectors, k=8):
    """Mean-centred whitening of (id, list) rows by numpy's eigenvalues: rows of (id, deviation, |whitened|), shares."""
    rows = [(i, [math.floor(1024.0 * c) + 100000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, n = np.array([r for _, r in rows], dtype=np.int64), len(rows)
    total = [sum(int(r[i]) for r in x) for i in range(x.shape[1])]
    y = x - np.array(total) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    off = [sum((n * int(a) - s) ** 2 for a, s in zip(r, total)) for r in x]
    return [(i, o, np.abs(w)) for (i, _), o, w in zip(rows, off, (y @ q) / np.sqrt(e))], e / np.trace(v)
