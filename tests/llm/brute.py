"""Plain versions of the operators, row by row on one machine."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    listed = ",".join(f"{name}:{start}:{end}" for start, _, end, name in spans)
    kinds = Counter(s[1] for s in spans)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(listed.encode()).hexdigest(), listed


def measures(text):
    text = text or ""
    words, lines, seen = WORD.findall(text), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(inside), failed


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def groups(docs, n, percent=80):
    """doc_id -> (set size, smallest doc_id reachable) for (doc_id, text) pairs with distinct ids."""
    sets = {d: shingles(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for a in ds for b in ds if a < b)
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def without_repeats(docs, n=20):
    """doc_id -> (words, removed, hash of the rest) for (doc_id, text) pairs in order."""
    seen, out = set(), {}
    for d, text in docs:
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - n + 1):
            run = tuple(words[i : i + n])
            if run in seen:
                gone.update(range(i, i + n))
            seen.add(run)
        rest = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = len(words), len(gone), hashlib.sha256(rest.encode()).hexdigest()
    return out


def check_packing(pieces, texts, tokenizer, window=1024, end_id=0):
    """Every id of every document in one piece, every sequence gapless; returns (sequences, padding). texts: {doc_id: [texts]}."""
    per, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        per[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(per) == set(texts)
    for d, own in texts.items():
        if len(own) != 1:
            want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in own)
            assert sum(p.length for p in per[d]) == want
            continue
        ids = np.array([*tokenizer.encode(own[0] or "", add_special_tokens=False).ids, end_id], "<u4")
        at = 0
        for p in sorted(per[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences), padding


def article(page):
    """The text of a page's one article, for pages whose article holds headings, paragraphs, bold text and breaks only."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("</?(?:b|br)>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(x for x in blocks if x)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves):
    """All levels of a tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest(*row[k : k + 2]) for k in range(0, len(row), 2)])
    return levels


def climb(levels, place, given):
    """The digest at the top when a leaf is given another digest, and the siblings on the way."""
    siblings = []
    for row in levels[:-1]:
        own = row[place ^ 1] if place ^ 1 < len(row) else None
        given = digest(given) if own is None else digest(own, given) if place % 2 else digest(given, own)
        siblings += [own] if own else []
        place //= 2
    return given, siblings


def best_documents(docs, queries, k):
    """(item, rank, doc, score) rows for (doc, text) and (item, text) pairs."""
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    split = [(d, Counter(own)) for d, own in ((d, terms(t)) for d, t in docs) if own]
    documents, tokens = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c in split:
            m = 25 + 75 * c.total() * documents // tokens
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text))
            scores += [(-score, d is None, d)] if score > 0 else []
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
