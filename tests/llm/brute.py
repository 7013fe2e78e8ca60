"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def repeats(docs, length=50):
    """docs: (doc_id, text). Rows of doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, (True, math.inf)), key(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(d):
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def base_scores(docs):
    toks = [(d, re.findall(WORD, lower(t or "")) + [None]) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter()
    for d, w in toks:
        if not held(d):
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in toks]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def fingerprint(t, words=3, distinct=False):
    w = re.findall(WORD, lower(t or ""))
    s = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in (set(s) if distinct else s)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def overlaps(docs, items, window=8):
    """Rows of doc_id, n_words, hit word places, item ids."""
    found = defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = re.findall(ALNUM, lower(t or "")), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in found:
                    ids |= found[x]
                    hit |= set(range(k, k + size))
        out.append((d, len(w), hit, sorted(ids)))
    return out


def lm_scores(docs, mix, step):
    """log10 of each text under counts quantised to the mean whole number of a level."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    toks = [(d, re.findall(WORD, lower(t or "")) + [None]) for d, t in docs]
    one, two = Counter(), Counter()
    for d, w in toks:
        if not held(d):
            one.update(w)
            two.update(zip([None, *w], w, strict=False))

    def read(c):
        if not c:
            return 0.0
        k = next(k for k in range(200) if c < step ** (k + 1))
        low, high = math.ceil(step**k), math.ceil(step ** (k + 1)) - 1
        return max(low, (low + high) / 2)

    n, v, out = sum(one.values()), len(one), []
    for d, w in toks:
        total = 0.0
        for a, b in zip([None, *w], w, strict=False):
            lower_p = (read(one[b]) + 1) / (n + v + 1)
            context = read(one[a])
            total += math.log10(mix * min(read(two[a, b]), context) / context + (1 - mix) * lower_p if context else lower_p)
        out.append((d, total))
    return out


def keep_first(docs):
    """docs: (doc_id, text). The one of each group of texts with a similarity of 0.8 or more in five-word shingles."""
    sets = []
    for _, t in docs:
        w = re.findall(WORD, lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = groups(len(docs), lambda a, b: sets[a] == sets[b] or (bool(sets[a] and sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))
    least = {}
    for k, (d, _) in enumerate(docs):
        key = (d is None, d or 0)
        least[root[k]] = min(least.get(root[k], key), key)
    return sorted((None if none else d for none, d in least.values()), key=lambda d: (d is not None, d or 0))


def without(text, words):
    """text without the runs of its words at these places."""
    spans = [m.span() for m in re.finditer(ALNUM, text)]
    out, at = [], 0
    for k in sorted(words):
        if k - 1 not in words:
            out.append(text[at : spans[k][0]])
        at = spans[k][1]
    return "".join([*out, text[at:]])
