"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def keyed(rows):
    """Distinct (id, text), a null id last."""
    return sorted({(i is None, i or 0, t) for i, t in rows}, key=lambda r: (r[0], r[1], r[2] or ""))


def windows(rows, size=20):
    seen, out = {}, {}
    for null, i, t in keyed(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[p : p + size]), (null, i, p)) < (null, i, p):
                gone[p : p + size] = [True] * size
        out[None if null else i, t] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def strings(rows, size=100):
    seen, out = {}, {}
    for null, i, t in keyed(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen.setdefault(b[p : p + size], (null, i, p)) < (null, i, p):
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[None if null else i, t] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def quality(t, least=6):
    w, t = WORD.findall(t or ""), t or ""

    def cover(k):
        c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    lines = [x for x in t.split("\n") if WORD.search(x)]
    longest = next((k - 1 for k in range(1, len(w) + 2) if not cover(k)), 0)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover(3)), len(cover(least)), longest


def shingles(t, k=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_chunks(own, ends, most=16):
    """(first, end) of chunks of lines: from each line to the next that ``ends`` tells a boundary, and to each line from the last before it."""
    full = [i for i, x in enumerate(own) if WORD.search(x)]
    flags, out = ends([own[i] for i in full]), set()
    for k in range(len(full) - 1):
        to = next((j for j in range(k + 1, len(full)) if flags[j]), len(full) - 1)
        out.add((full[k], full[min(to, k + most - 1)] + 1))
    for k in range(1, len(full)):
        since = next((j for j in range(k - 1, -1, -1) if flags[j]), 0)
        out.add((full[max(since, k - most + 1)], full[k] + 1))
    return sorted(out)


def without_repeated_chunks(rows, ends):
    """(id, text) -> lines, lines removed, what is left: chunks that start earlier in another place go."""
    seen, out = set(), {}
    for null, i, t in keyed(rows):
        own = t.split("\n") if t else []
        gone = set()
        for a, b in line_chunks(own, ends):
            key = "\n".join(own[a:b])
            gone |= set(range(a, b)) if key in seen else set()
            seen.add(key)
        out[None if null else i, t] = len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out
