"""Plain versions of the operators' contracts, on lists of rows."""

import hashlib
import math
import re
import zlib
from base64 import b32encode
from collections import Counter
from fractions import Fraction

import xxhash

WS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def simhash(text):
    ws = words(ascii_lower(text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows, radius=4):
    """rows: (id, fingerprint) -> list of the smallest id reachable from each."""
    fps = sorted({fp for _, fp in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[root(fp)] = min(i, least.get(root(fp), i))
    return [least.get(root(fp)) for _, fp in rows]


def contamination(text, items, width=13):
    ws = bench_words(text)
    hit, found = [False] * len(ws), set()
    at = {}
    for k, w in enumerate(ws):
        at.setdefault(w, []).append(k)
    for item, item_text in items:
        iw = bench_words(item_text)
        if not iw:
            continue
        for k in range(max(1, len(iw) - width + 1)):
            window = iw[k : k + width]
            for begin in at.get(window[0], ()):
                if ws[begin : begin + len(window)] == window:
                    found.add("" if item is None else str(item))
                    hit[begin : begin + len(window)] = [True] * len(window)
    n = sum(hit)
    return len(ws), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(ws)


def targets(sizes):
    """sizes: source -> size; shares by repeated passes, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, fixed, free = Fraction(sum(sizes.values())), {}, list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            fixed |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            fixed[s] = Fraction(3 * sizes[s])
        left -= sum(fixed[s] for s in over)
        free = [s for s in free if s not in over]
    return {s: float(v) for s, v in fixed.items()}


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def unigrams(rows):
    """rows: (id, text) -> (held_out, n_tokens, n_known, N, base) of each."""
    seen = Counter()
    toks = []
    for i, text in rows:
        t = [*words(ascii_lower(text or "")), None]
        toks.append(t)
        if i is not None and fold(i, 7) != 2:
            seen.update(t)
    n, v = sum(seen.values()), len(seen)
    return [(i is not None and fold(i, 7) == 2, len(t), sum(seen[w] > 0 for w in t), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)) for (i, _), t in zip(rows, toks, strict=True)]


def suffix_tree(rows, depth):
    """rows: (id, text) -> (n_tokens, log10 probability) of each, from dictionaries of contexts as tuples of symbols."""
    texts = [["<s>", *words(ascii_lower(text or "")), None] for _, text in rows]
    known = [t for (i, _), t in zip(rows, texts, strict=True) if i is not None and fold(i, 7) != 2]
    n, follow = Counter(w for t in known for w in t[1:]), {}
    total, kinds = sum(n.values()), len(n)
    for t in known:
        for k in range(1, len(t)):
            for d in range(1, min(depth, k) + 1):
                follow.setdefault(tuple(t[k - d : k]), Counter())[t[k]] += 1
    nodes = {}

    def chance(context, w):
        p = (n[w] + 1) / (total + kinds + 1)
        for d in range(1, len(context) + 1):
            if context[-d:] in nodes:
                c = nodes[context[-d:]]
                p = (c[w] + len(c) * p) / (sum(c.values()) + len(c))
        return p

    for context in sorted(follow, key=len):
        c = follow[context]
        size = sum(c.values())
        if size >= 2 and sum(m * math.log(m / size / chance(context[1:], w)) for w, m in c.items()) > len(c) * math.log(total) / 2:
            nodes[context] = c
    return [(len(t) - 1, sum(math.log10(chance(tuple(t[max(0, k - depth) : k]), t[k])) for k in range(1, len(t)))) for t in texts]


def shingle_likeness(a, b, width=5):
    def of(text):
        ws = words(text.lower())
        return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def base32_sha1(data):
    return b32encode(hashlib.sha1(data).digest()).decode()
