"""Brute-force forms that several tests share."""

import functools

import xxhash


def brute_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    n = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(len(ws) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    from lodestar.llm.tokens import default_path

    return Tokenizer.from_file(default_path())


def ids_of(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


def grams(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def alike(a, b):
    """Near copies: Jaccard similarity of 0.8 or more of five-word shingles."""
    a, b = (x if isinstance(x, set) else grams(x) for x in (a, b))
    return a == b or len(a & b) >= 0.8 * len(a | b)


def alike_roots(texts):
    """For each text the first of its component of near copies."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and root[i] != root[j] and alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root
