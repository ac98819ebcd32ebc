"""Entropy classes go by window, whatever shares the run."""

import math
import random
import re
import string
from collections import Counter

from lodestar.llm import secrets as S


def test_hex_beside_other_characters_and_digits_fire():
    secret = "9F86D081884C7D659A2FEAA0C55AD015"
    for run in (f"AUTH={secret}", f"client_id={secret[:28].lower()}", f"sk_live_{secret.lower()}"):
        at = run.lower().index(secret[:28].lower())
        assert any(a <= at and b >= at + 28 for _, a, b in S.entropy_spans(run)), run
    assert S.entropy_spans("83059271640285917364092518")[0][0] == "entropy_digits"
    assert S.entropy_spans("2024-01-02/2024-03-04/2025-06-07") == []
    assert S.entropy_spans("0" * 40) == []


def brute(run):
    """Every window counted anew, those that meet a placeholder left out, merged where they touch."""
    if len(run) < S.WINDOW or S.allowed(run):
        return []
    good = []
    for a in range(len(run) - S.WINDOW + 1):
        w = run[a : a + S.WINDOW]
        bits = -sum(n / S.WINDOW * math.log2(n / S.WINDOW) for n in Counter(w).values())
        if any(m.start() < a + S.WINDOW and m.end() > a for m in S.PLACEHOLDER.finditer(run)):
            continue
        if bits + 1e-7 >= S.THRESHOLD[S.char_class(w)]:
            good.append(a)
    out = []
    for a in good:
        if out and a <= out[-1][1]:
            out[-1][1] = a + S.WINDOW
        else:
            out.append([a, a + S.WINDOW])
    return [(S.char_class(run[a:b]), a, b) for a, b in out]


def test_windows_against_brute_force(docs):
    rng = random.Random(11)
    alphabets = ["0123456789", "0123456789abcdef", "ABCDEF0123456789", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_.=-", "ab1"]
    runs = {m for d in docs for m in re.findall(r"[A-Za-z0-9+/_.=-]{24,}", d["text"] or "")}
    for _ in range(300):
        parts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        runs.add(rng.choice(["", "xxxx", "example", "-"]).join(parts))
    found = set()
    for r in runs:
        got = S.entropy_spans(r)
        assert got == brute(r), r
        found |= {k for k, _, _ in got}
    assert found == set(S.KINDS[3:])  # every class can fire


def test_placeholders_and_words_suppress_no_more_than_themselves():
    rng = random.Random(2)
    secret = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(100))
    (a, b) = (x[1:] for x in S.entropy_spans(secret + "xxxx" + secret[::-1]))
    assert a == (0, 100) and b == (104, 204)
    mixed = "".join(rng.choice(string.ascii_letters) for _ in range(60))  # no digit, yet no word
    assert S.entropy_spans(mixed)
    assert not S.entropy_spans("internationalisationandlocalisation") and not S.entropy_spans("/usr/share/applications/defaults.list")
