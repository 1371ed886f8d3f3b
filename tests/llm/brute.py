"""Plain single-machine versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or ""))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def simhash(docs):
    """docs: [(doc_id, text)] -> sorted [(doc_id, hex, component)]"""
    marks = []
    for _, text in docs:
        words = space_words((text or "").translate(UPPER))
        shingles = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
        hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = root(i)
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(d, f"{marks[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)]


def repeats(docs, length=200):
    """docs: [(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, sha)]"""
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(docs, raws):
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contaminated(docs, items, window=10):
    """-> [(doc_id, n_words, n_hit, n_items, sha, flag)]"""
    windows = defaultdict(set)
    for item_id, text in items:
        words = item_words(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows[tuple(words[i:i + window])].add(str(item_id))
    out = []
    for doc_id, text in docs:
        words, hit, names = item_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    names |= windows[w]
        out.append((doc_id, len(words), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, rounds=2):
    """sizes: source -> words; water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        busy = [s for s in order if s not in full]
        if not busy:
            return full
        level = left / sum(weight[s] for s in busy)
        over = [s for s in busy if level * weight[s] > rounds * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in busy}
        for s in over:
            full[s] = rounds * sizes[s]
            left -= full[s]


def mix(docs, seed="mix-0", weights=(5, 2, 1), share=1.5, rounds=2):
    """docs: [(doc_id, text, source)] of distinct doc_ids -> {doc_id: copies}"""
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(space_words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    queue = []
    for at, source in enumerate(order):
        rows = sorted((hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d, len(space_words(t))) for d, t, s in docs if s == source)
        served = 0
        for turn in range(rounds):
            for place, d, n in rows:
                served += n
                queue.append((served / weights[at % len(weights)], at, turn, place, d, n))
    spent, copies = 0, Counter()
    for *_, d, n in sorted(queue):
        spent += n
        if spent <= int(share * sum(sizes.values())):
            copies[d] += 1
    return copies


def top_k(rows, k=5, every=50):
    """rows: [(vec_id, vector)] -> [(query_id, rank, vec_id, score)]"""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def crc32(text):
    return zlib.crc32(text.encode())


def backoff(docs, order=3, weight=0.4):
    """docs: [(doc_id, text)] -> [(doc_id, n_words, log_score, n_backoff)], each row scored by the words of the other rows"""
    split = [tuple((t or "").encode().lower().split()) for _, t in docs]
    grams = [Counter(w[i:i + k] for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in split]
    total, words = sum(grams, Counter()), sum(map(len, split))
    out = []
    for (doc_id, _), w, own in zip(docs, split, grams):
        s, backed, count = 0.0, 0, lambda g, own=own: total[g] - own[g]
        for i in range(len(w)):
            longest = min(i + 1, order)
            k = next((k for k in range(longest, 1, -1) if count(w[i + 1 - k:i + 1])), 1)
            g = w[i + 1 - k:i + 1]
            s += (longest - k) * math.log(weight) + math.log(count(g) / count(g[:-1]) if k > 1 else (count(g) or weight) / max(words - len(w), 1))
            backed += k < order
        out.append((doc_id, len(w), s, backed))
    return out


def chats(rows):
    """rows: [(conv_id, turn, role, text)] -> {conv_id: rendered}"""
    convs = defaultdict(set)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].add((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(t))
    logs = {c: [t[1:] for t in sorted(s, key=key)] for c, s in convs.items()}
    kept = {}
    for c, log in logs.items():
        longer = any(len(o) > len(log) and o[:len(log)] == log for o in logs.values())
        twin = any(o == log and d < c for d, o in logs.items())
        if not longer and not twin:
            kept[c] = "".join(f"<|{r if r is not None else 'unknown'}|>\n{t or ''}\n" for r, t in log)
    return kept
