"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def spaced(text):
    return (text or "").encode().split()


def removed(texts, window=35):
    """(words, removed, hash of the kept words) of each text."""
    words = [spaced(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def linked(texts):
    """Links per text and a group number per text."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and common * 10 >= 8 * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return links, [top(i) for i in range(len(texts))]


def license_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def license_base(text):
    """(words, places, first, last, labels)."""
    w = license_words(text)
    places = defaultdict(list)
    for label, phrase in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
        for i in range(len(w)):
            if w[i : i + len(phrase)] == phrase:
                places[label].append(i)
    every = sorted(i for p in places.values() for i in p)
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(places))


def common(item, words):
    """Length of the longest common subsequence, with the rows of the table as bits of a number."""
    bits = defaultdict(int)
    for i, w in enumerate(item):
        bits[w] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        both = row & bits.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(item) - bin(row).count("1")


def leaks(words, item, passage=64, step=32):
    """Whether any passage of the text, with as many words around it as the item has, holds the item:
    80 % of its words in order, or 60 % and its last three words together."""
    if not item:
        return False
    for start in range(0, max(len(words), 1), step):
        near = words[max(0, start - len(item)) : start + passage + len(item)]
        share = common(item, near) / len(item)
        answer = item[-3:]
        if share >= 0.8 or share >= 0.6 and any(near[i : i + len(answer)] == answer for i in range(len(near))):
            return True
    return False
