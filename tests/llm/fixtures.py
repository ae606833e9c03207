"""Small document tables with everything that operators must stand, and plain versions of what they compute."""

from __future__ import annotations

import hashlib
import random
import re

WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, kept string, ranges string, word string, block int"


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    """(doc_id, text): random words, copies, near copies, shared and repeated passages, nulls, blanks and a long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = sentence(40), sentence(15)
    texts = [None, "", " \t\n", "one", "One two", "one TWO", sentence(13), line, line]
    base = sentence(200)
    texts += [base, base, base]
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    while len(texts) < n:
        parts = [sentence(r.randint(1, 80)) for _ in range(3)]
        if r.random() < 0.4:
            parts.insert(r.randrange(4), passage)
        if r.random() < 0.3:
            parts += [line] * r.randint(1, 3)
        texts.append(r.choice([" ", "\n", "    "]).join(parts))
    texts.append(" ".join([line] * 60) + " " + "x" * 5000)
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """A documents table with clashing further columns; rows of (doc_id, text)."""
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if d is None or d % 7 else None, len(t or ""), 1, "x", "y", "z", 0) for d, t in rows], SCHEMA)


def removed_bytes(rows, width):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mark = [False] * len(b)
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                mark[i : i + width] = [True] * width
            seen.add(s)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(m and not p for m, p in zip(mark, [False, *mark]))
        out[d] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def removed_words(rows, width):
    first, out = {}, {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_set(text, k=3):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(rows, percent=85, k=3):
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
