"""Secret scans: rule matches plus sliding-window entropy over candidate strings.

Rules (leftmost, not overlapping, per kind): credential assignments, access keys, long
lower-case hex.  The method adds spans: a candidate is a maximal run of
``[A-Za-z0-9+/_.=-]`` of at least ``window`` characters.  A window slides over it while
counts of its characters are kept up to date, so each step costs two updates whatever
the window's length.  Its Shannon entropy is held against the threshold of the
candidate's character class (digits, hex, letters and digits, base64-like); windows at or
over it merge into one span.  A span inside a rule's span isn't repeated, and the
allow list (UUIDs, URLs and paths, dotted names, versions and dates, words; windows that
meet a documentation placeholder) suppresses entropy spans only, never rule matches.

Candidates are found over a whole Arrow batch at once by a byte-class table, so ordinary
prose costs a few nanoseconds a byte; only documents that hold a credential keyword see
the assignment expression.  No shuffle: one narrow pass over the texts.

Defined cases: null text counts as empty, an empty text has no spans and the digest of
the empty string; repeated rows repeat their result; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, ship, text_or_empty

KINDS = ("assign", "access", "hex", "entropy_digits", "entropy_hex", "entropy_alnum", "entropy_base64")
ORDER = {k: i for i, k in enumerate(KINDS)}
KEYWORD = r"(?:password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WINDOW = 24
#: Bits a character in a window of 24 from which a class counts as random (log2 of 24 is 4.58).
THRESHOLD = {"entropy_digits": 3.1, "entropy_hex": 3.3, "entropy_alnum": 4.0, "entropy_base64": 4.1}
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
PLAIN = re.compile(r"(?![0-9]+\Z)[0-9./:+_=-]*")  # dates, versions, numbers with separators (not bare digits), rules
SEPARATORS, DIGITS, TURNS = re.compile(r"[./_=-]+"), re.compile(r"[0-9]+"), re.compile(r"[a-z](?=[A-Z])")
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|xxxx|changeme|redacted|lorem", re.IGNORECASE)
TABLE = np.zeros(256, np.uint8)
TABLE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = 1
XLOGX = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


def char_class(run: str) -> str:
    if run.isdigit():
        return "entropy_digits"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "entropy_hex"
    return "entropy_alnum" if run.isalnum() else "entropy_base64"


def wordy(part: str) -> bool:
    """A name: at most two numbers of at most four digits, at most three humps."""
    numbers = DIGITS.findall(part)
    return len(numbers) <= 2 and all(len(n) <= 4 for n in numbers) and len(TURNS.findall(part)) <= 3


def allowed(run: str) -> bool:
    """Is this candidate on the allow list: a UUID, numbers, a word, or a path or dotted name of wordy parts?"""
    if UUID.fullmatch(run) or PLAIN.fullmatch(run):
        return True
    parts = [p for p in SEPARATORS.split(run) if p]
    return (len(parts) > 1 or not DIGITS.search(run)) and all(map(wordy, parts))


def entropy_spans(run: str, window: int = WINDOW, threshold: dict[str, float] = THRESHOLD) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the merged windows whose entropy reaches the threshold of their own class.

    Windows that meet a placeholder don't count.
    """
    if len(run) < window or allowed(run):
        return []
    spans, counts, s = [], {}, 0.0  # s: sum of n log n
    least = min(threshold.values())
    fake = [(m.start(), m.end()) for m in PLACEHOLDER.finditer(run)]
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        s += XLOGX[n + 1] - XLOGX[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            s += XLOGX[n - 1] - XLOGX[n]
        a = i - window + 1
        while fake and fake[0][1] <= a:  # behind the window
            fake.pop(0)
        bits = math.log2(window) - s / window + 1e-9
        if a >= 0 and bits >= least and not (fake and fake[0][0] <= i) and bits >= threshold[char_class(run[a : i + 1])]:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return [(char_class(run[a:b]), a, b) for a, b in spans]


def assign_spans(text: str) -> list[tuple[str, int, int]]:
    return [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]


def run_spans(run: str) -> list[tuple[str, int, int]]:
    """Spans within one maximal run of candidate characters, offsets in the run."""
    out = [("access", m.start(), m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= 32]
    return out


def candidate_runs(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte [start, end) of maximal runs of candidate bytes of ``least`` or more; ``starts``: where documents begin."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = TABLE[data]
    step = np.flatnonzero(np.diff(inside))
    a, b = step[::2], step[1::2]
    if len(a) == 0:
        return a, b
    cut = starts[(starts > 0) & (starts < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a run that goes on over a boundary
    if len(cut):
        a, b = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
    keep = b - a >= least
    return a[keep], b[keep]


def finish(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        found: dict[int, list] = {}
        for i in np.flatnonzero(pc.match_substring_regex(texts, KEYWORD, ignore_case=True).to_numpy(zero_copy_only=False)):
            if spans := assign_spans(texts[int(i)].as_py()):
                found[int(i)] = spans
        a, b_ = candidate_runs(data, offsets[:-1], 16)
        where = np.searchsorted(offsets, a, side="right") - 1
        more: dict[int, list] = {}
        for i, x, y in zip(where.tolist(), a.tolist(), b_.tolist()):
            run = data[x:y].tobytes().decode("ascii")
            base, extra = run_spans(run), entropy_spans(run)
            if base or extra:
                more.setdefault(i, []).append((x - int(offsets[i]), base, extra))
        out = {f.name: [] for f in SCHEMA}
        none = hashlib.sha256(b"").hexdigest()
        for i, doc_id in enumerate(ids.to_pylist()):
            base, extra = found.get(i, []), []
            if i in more:
                at, chars = 0, 0  # code points before a byte, counted once along the text
                doc = data[offsets[i] : offsets[i + 1]]
                for x, bs, es in more[i]:
                    chars += int(np.count_nonzero((doc[at:x] & 0xC0) != 0x80))
                    at = x
                    base = base + [(k, chars + p, chars + q) for k, p, q in bs]
                    extra = extra + [(k, chars + p, chars + q) for k, p, q in es]
                extra = [e for e in extra if not any(p <= e[1] and e[2] <= q for _, p, q in base)]
            kinds = [k for k, _, _ in base]
            out["doc_id"].append(doc_id)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(finish(base).encode()).hexdigest() if base else none)
            out["spans"].append(finish(base + extra))
            out["n_entropy"].append(len(extra))
        yield batch(out, SCHEMA)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    kinds = {"int64": "long", "string": "string"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in SCHEMA))
