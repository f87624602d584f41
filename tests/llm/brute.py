"""The contracts of the text operators, word for word and slow."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return LETTERS.findall((text or "").translate(LOWER))


def spaced(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def contamination(text, items, size=10):
    """(n_words, n_hit, sorted items) of one text against (item_id, text) rows."""
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        if item_id is None:
            continue
        w = words(item)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if k else ():
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item_id))
    return len(own), len(hit), sorted(found)


def substring_dedup(texts, size=35):
    """(n_words, n_removed, kept text) of every text."""
    counts = Counter(tuple(w[i : i + size]) for w in map(spaced, texts) for i in range(len(w) - size + 1))
    out = []
    for w in map(spaced, texts):
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k=5):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, percent=75):
    """doc_id -> (set size, component) of distinct ids, by all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    shared = Counter((a, b) for ds in inverted.values() for a in ds for b in ds if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def phrase_places(text, phrases):
    w, places, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
