"""Plain Python versions of the contracts, for small fixtures."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                          re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def secret_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "")
             if len(m.group(g)) >= n]
    return sorted(found)


def exact_groups(rows):
    """rows: (id, text) -> id, keep_id, group_size, kept, sha per row."""
    norm = [SPACE.sub(" ", t or "") for _, t in rows]
    size = Counter(norm)
    keep = {}
    for (i, _), t in zip(rows, norm):
        if i is not None:
            keep[t] = min(i, keep.get(t, i))
    return [(i, keep.get(t), size[t], i == keep.get(t), sha(t)) for (i, _), t in zip(rows, norm)]


def jaccard_components(rows):
    """(id, set size, component) per row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(sets[a]), None if i is None else least[find(a)]) for a, (i, _) in enumerate(rows)]


def bpe(rows):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    return out


def without_repeats(rows, window=100):
    """(id, bytes, removed, spans, sha of the rest) per distinct document, in order of id."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - window + 1):
            w = b[a:a + window]
            if w in seen:
                gone[a:a + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def base_scores(rows):
    """(id, held out, tokens, known, N, base score) per row."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [words(t) + [None] for _, t in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total = sum(count.values())
    return [(i, h, len(t), sum(count[w] > 0 for w in t), total,
             sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t))
            for (i, _), h, t in zip(rows, held, tokens)]
