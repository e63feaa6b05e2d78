"""Plain versions of the operators, over lists of (doc_id, text, ..) rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def component_ids(rows, n, percent):
    """Per row: the smallest id of its component; rows without shingles keep their own."""
    sets = [shingles(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return [least.get(find(i)) if sets[i] else r[0] for i, r in enumerate(rows)]


def without_repeats(texts, width=100):
    """(bytes, removed, spans, kept) of texts in document order."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def held_items(text, items, n=5, percent=80):
    s = shingles(text, n)
    return {i for i, t in items if shingles(t, n) and 100 * len(s & shingles(t, n)) >= percent * len(shingles(t, n))}
