"""Small documents with the awkward cases, and plain versions of the operators to compare with."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, rank int, words string, tk int, label string"
LETTERS = {"en": "etaoinshr", "de": "enisräßch", "fr": "esaitréèç", "es": "eaosnñíóc"}


def word(rng, lang="en"):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7)))


def sentence(rng, n, lang="en"):
    return " ".join(word(rng, lang) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    w = base.split()
    near = [" ".join(w[:i] + [word(rng)] + w[i + 1 :]) for i in (5, 50, 90)]
    chain = [base]
    for i in range(10, 110, 12):
        v = chain[-1].split()
        v[i : i + 2] = [word(rng), word(rng)]
        chain.append(" ".join(v))
    shared = [f"{sentence(rng, 20)} {passage}\n{sentence(rng, 15)}" for _ in range(5)]
    long = sentence(rng, 6000)
    out = [base, base.upper(), base, *near, *chain, *shared, long, long + " tail", None, "", "   \n\t", "one", "one", "two words", "a b c", "A b  c", "%%% ***", "é", passage, "x " * 200, "x " * 200 + "y"]
    out += [sentence(rng, rng.randint(1, 80), rng.choice("en de fr es".split())) for _ in range(60)]
    return out


def documents(spark, rows=None, ids=None):
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    langs = [None, "en", "de", "fr"]
    data = [(i, t, langs[k % 4], ["a", "b", None, "é"][k % 4], None if t is None else len(t), 7, "k", 1, 2, "w", 3, "l") for k, (i, t) in enumerate(zip(ids, rows, strict=True))]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def thue_morse(a="a", b="b", n=1024):
    """Two words that powers of any odd base modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def linked(rows, k, above, below):
    """Set sizes and least reachable place, by comparing all pairs."""
    sets = []
    for t in rows:
        w = spaced(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and below * len(a & sets[j]) >= above * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def cut_repeats(rows, window):
    """Words left of each text."""
    first = {}
    words = [spaced(t) for t in rows]
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def hits(rows, items, window):
    """(words, hit words, names of items) of each text."""
    wins = defaultdict(set)
    for name, t in items:
        w = alnum(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(name)
    sizes = {len(x) for x in wins}
    out = []
    for t in rows:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(w), len(hit), found))
    return out


__all__ = ["Counter", "alnum", "cut_repeats", "documents", "hits", "linked", "low", "sentence", "spaced", "texts", "word"]
