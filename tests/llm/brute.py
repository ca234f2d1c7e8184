"""Brute-force versions of the operators that SQL cannot express, and a fixture of odd documents."""

import random
import re
from collections import Counter

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=5):
    """Prose with exact copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["Straße", "naïve", "日本語", "x"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(60)
    texts = [None, "", " \t\n", "One", "one", "a b c d", "A  b\tc d", prose(3000), "z" * 700, "ab" * 300]
    while len(texts) < n:
        kind, old = rng.random(), rng.choice([t for t in texts if t and len(t) > 200])
        if kind < 0.2:
            texts.append(old)
        elif kind < 0.45:
            w = old.split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.65:
            texts.append(f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 40))}")
        else:
            texts.append(prose(rng.randint(1, 200)))
    return [(10 * i, t, "en", None if i % 7 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def shingles(text, size=5):
    w = _SPACED.findall((text or "").translate(_LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows):
    """{id: (n_shingles, component)} over all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, places = sorted(sets), {}
    for i in ids:
        shared = Counter(j for x in sets[i] for j in places.get(x, ()))
        for j, both in shared.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
        for x in sets[i]:
            places.setdefault(x, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, length=100):
    """{id: (kept bytes, removed, spans)}."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(raw[s : s + length])
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone), spans
    return out


def word_count(text):
    return len(_SPACED.findall(text or ""))
