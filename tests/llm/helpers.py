"""Fixtures and brute-force versions for the training-data operators."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words int, content string, n int, hash int, shard int, size string, spans int, comp int, frags int"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=5, n=60):
    """Documents with nulls, empty texts, copies, near copies, shared passages, one very long text and odd white space."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = make(70)
    texts = [None, "", "   \t\n ", "One", "one", "a b c d", "A b  c\td", " ".join(make(9000))]
    for k in range(n):
        w = make(rng.randint(20, 160))
        if k % 4 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", "  "]) for x in w))
        if k % 3 == 0:
            texts.append(texts[-1] if k % 2 else texts[-1].upper())
        if k % 5 == 0:
            near = words(texts[-1])
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    order = rng.sample(range(len(texts)), len(texts))
    return [(order[k] * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", "é", None]), None) for k, t in enumerate(texts)]


def frame(spark, rows):
    """As a table of several partitions with extra columns whose names clash with inner ones."""
    full = [(*r, "x", 1, "y", 2, 3, 4, "z", 5, 6, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def components(rows, n=5, percent=75):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def kept_words(rows, window):
    """{doc_id: (words, removed, kept)} by looking at every window."""
    first, out = {}, {}
    for d, t, *_ in sorted(rows):
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i:i + window]), d) < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def by_group(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
