"""Plain versions of what the operators compute, for small inputs."""

from collections import Counter, defaultdict


def shingles(text, short=False):
    words = (text or "").lower().split()
    if len(words) < 5:
        return Counter([tuple(words)]) if short and words else Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(docs, threshold=0.8):
    """Smallest id of each (id, text)'s component of weighted Jaccard links."""
    counts = [shingles(text, short=True) for _, text in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i, count in enumerate(counts):
        for s in count:
            places[s].append(i)
    overlap = Counter()
    for s, found in places.items():
        for i, x in enumerate(found):
            for y in found[i + 1 :]:
                overlap[x, y] += min(counts[x][s], counts[y][s])
    for (x, y), both in overlap.items():
        if both >= threshold * (counts[x].total() + counts[y].total() - both) - 1e-9:
            parent[root(x)] = root(y)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [least[root(i)] for i in range(len(docs))]


def contained(docs, items, threshold=0.8):
    known = {i: set(shingles(text)) for i, text in items}
    found = set()
    for doc, text in docs:
        own = set(shingles(text))
        for item, wanted in known.items():
            if wanted and len(own & wanted) >= threshold * len(wanted) - 1e-9:
                found.add((doc, item, len(own & wanted), len(wanted)))
    return found


def covered(docs, length=100):
    """For each (id, text) in order of id: a flag for every byte that goes."""
    seen, out = {}, {}
    for at, (doc, text) in sorted(enumerate(docs), key=lambda x: (x[1][0] is not None, x[1][0])):
        code = (text or "").encode()
        flags = bytearray(len(code))
        for i in range(len(code) - length + 1):
            string = code[i : i + length]
            if seen.setdefault(string, (doc, i)) != (doc, i):
                flags[i : i + length] = b"\1" * length
        out[at] = flags
    return [out[i] for i in range(len(docs))]


def left(text, flags):
    return bytes(c for c, f in zip((text or "").encode(), flags) if not f)
