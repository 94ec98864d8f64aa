"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations


def words(text):
    return re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", (text or "").lower().encode())


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_classes(texts, similarity=0.8):
    """texts: list -> per position (class as smallest position, number of links)."""
    sets = [shingles(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        union = len(sets[a] | sets[b])
        if union and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * union - 1e-9:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(root(i), links[i]) for i in range(len(texts))]


def removal(texts, length=100):
    """texts: dict id -> text; per id (bytes, removed, spans, hash of the rest)."""
    seen, out = set(), {}
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contained(documents, items, least=0.8):
    """Set of (doc, item, shared) with exact containment of 5-grams."""
    out = set()
    for d, text in documents.items():
        have = shingles(text)
        for i, item in items.items():
            want = shingles(item)
            shared = len(want & have)
            if want and shared >= least * len(want) - 1e-9:
                out.add((d, i, shared))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def katz(texts, held, vocabulary, ratios):
    """texts: list of token lists -> (log10 probabilities, P(class | history), classes); see the operator's module."""
    counts = Counter(t for tokens, h in zip(texts, held) if not h for t in tokens)
    ranked = Counter(n for t, n in counts.items() if t is not None)
    have, least = 0, 1 << 60
    for n in sorted(ranked, reverse=True):
        if have + ranked[n] > vocabulary:
            break
        have, least = have + ranked[n], n
    own = lambda t: t if t is None or counts[t] >= least else "<rest>"
    by_class = Counter({"<rest>": 0, None: counts[None]})
    for t, n in counts.items():
        if t is not None:
            by_class[own(t)] += n
    total = sum(n + 0.1 for n in by_class.values())
    unigram = {c: (n + 0.1) / total for c, n in by_class.items()}
    pairs = defaultdict(Counter)
    for tokens, h in zip(texts, held):
        if not h:
            for a, b in zip(["<start>", *map(own, tokens)], map(own, tokens)):
                pairs[a][b] += 1
    ratio = ratios([0, *(sum(n == r for p in pairs.values() for n in p.values()) for r in range(1, 7))])

    def prob(h, c):
        if h not in pairs:
            return unigram[c]
        n, seen = sum(pairs[h].values()), pairs[h]
        p = {x: (ratio[r - 1] if r <= 5 else 1) * r / n for x, r in seen.items()}
        base, left = sum(unigram[x] for x in seen), 1 - sum(p.values())
        if 1 - base < 1e-9:
            return p[c] / sum(p.values())
        if left < 1e-12:
            return p[c] * n / (n + 1) if c in p else unigram[c] / (n + 1) / (1 - base)
        return p[c] if c in p else unigram[c] * left / (1 - base)

    return prob, own, counts, by_class
