"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Candidate strings for the entropy scan, and per character class: the window and the bits per character it must reach.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+\Z"), 20, 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 20, 3.9))
#: Runs of one alphabet within a candidate: the bits that all but 0.5 % of random strings of the alphabet reach in a window
#: of 20 (100,000 simulated), and what a window must hold besides, as words and numbers alone reach so much too.
RUNS = [
    (re.compile(f"[{chars}]{{20,}}"), 20, least, [re.compile(f"[{x}]") for x in must])
    for chars, least, must in (
        ("0-9a-f", 2.828, ("0-9", "a-f")),
        ("0-9A-F", 2.828, ("0-9", "A-F")),
        ("a-z2-7", 3.284, ("0-9", "a-z")),
        ("A-Z2-7", 3.284, ("0-9", "A-Z")),
        ("a-z0-9", 3.346, ("0-9", "a-z")),
        ("A-Z0-9", 3.346, ("0-9", "A-Z")),
        ("A-Za-z0-9", 3.584, ("0-9", "A-Z", "a-z")),
        ("A-Za-z0-9+/", 3.609, ("0-9", "A-Z", "a-z")),
        ("A-Za-z0-9_-", 3.609, ("0-9", "A-Z", "a-z")),
    )
]
#: Candidates that are no secrets: paths and dashed or snake-case words, numbers alone, letters alone.
ALLOWED = re.compile(r"[0-9+/_=-]+\Z|[A-Za-z+/_=-]+\Z|(?:[A-Za-z]+[-_/=+]|[0-9]{1,4}[-_/=+])+(?:[A-Za-z]*|[0-9]{1,4})\Z")
ALPHABETS = ("0123456789abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789")
#: Fewest characters of a counting sequence; one at the front of a candidate is left out of it.
SEQUENCE = 12
_KEY = re.compile(r"(?ai)pass|secret|token|api")


def entropy_spans(text: str, window: int, least: float, must: Sequence[re.Pattern] = ()) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy, in bits per character, reaches `least`, and in which each of `must` is
    found; counts move by one each step."""
    n = len(text)
    if n < window:
        return []
    steps = [c * np.log2(c) if c else 0.0 for c in range(window + 1)]
    counts: dict[str, int] = {}
    spread, spans = 0.0, []  # spread: sum of c log2 c over the window
    for i, ch in enumerate(text):
        if i >= window:
            c = counts[old := text[i - window]]
            spread += steps[c - 1] - steps[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        spread += steps[c + 1] - steps[c]
        counts[ch] = c + 1
        if i >= window - 1 and np.log2(window) - spread / window >= least - 1e-9:
            a = i - window + 1
            if not all(p.search(text, a, i + 1) for p in must):
                continue
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def allowed(candidate: str) -> bool:
    return bool(ALLOWED.match(candidate))


def after_sequences(candidate: str) -> int:
    """Where a candidate goes on after the counting sequences (of SEQUENCE characters or more) that it begins with."""
    low, at = candidate.lower(), 0
    while True:
        k = at + len(low[at:]) - len(low[at:].lstrip("+/_=-"))
        n = SEQUENCE
        if k + n > len(low) or not any(low[k : k + n] in 2 * a for a in ALPHABETS):
            return at
        while k + n < len(low) and any(low[k : k + n + 1] in 2 * a for a in ALPHABETS):
            n += 1
        at = k + n


def candidate_spans(candidate: str) -> list[tuple[int, int]]:
    """Entropy spans after a candidate's sequences, by the class of all the rest and by runs of smaller alphabets; those that
    touch are one."""
    found: list[tuple[int, int]] = []
    at = after_sequences(candidate)
    part = candidate[at:]
    if len(part) >= 20 and not allowed(candidate) and not allowed(part):
        _, _, window, least = next(c for c in CLASSES if c[1].match(part))
        found += [(at + a, at + b) for a, b in entropy_spans(part, window, least)]
        for run, window, least, must in RUNS:
            for m in run.finditer(part):
                if all(p.search(m[0]) for p in must):
                    found += [(at + m.start() + a, at + m.start() + b) for a, b in entropy_spans(m[0], window, least, must)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind as listed in KINDS."""
    out = []
    if _KEY.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    candidates = CANDIDATE.findall(text)
    if candidates:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        for m in CANDIDATE.finditer(text):
            out += [(m.start() + a, 3, m.start() + b) for a, b in candidate_spans(m[0])]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [spans_of(t or "") for t in b.column(1).to_pylist()]
        show = lambda s: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in s)
        counts = [pa.array([sum(x[1] == k for x in s) for s in found], pa.int64()) for k in range(4)]
        base = [hashlib.sha256(show([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.string()), pa.array([show(s) for s in found], pa.string())], _SPAN_NAMES)


_SPAN_NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row of docs; a null text is empty and has
    no spans, a null id stays null, other columns are ignored. One pass over whole texts, no shuffle. Entropy spans add to
    the base ones, which stay as the patterns give them; a candidate that the allow-list matches (words joined by dashes,
    numbers, letters alone) has none, and counting sequences at its front are left out of it."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_scan), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redacted(text: str | None, mask: str) -> str | None:
    """The text with every span replaced by the mask; spans that touch or overlap become one mask."""
    if not text:
        return text
    out, at = [], 0
    for a, _, e in spans_of(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in `text` masked, and n_chars (where there is one) counted anew. Other columns pass unchanged;
    a null text stays null and an empty one empty; repeated rows stay; an empty table gives an empty one."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([redacted(t, mask) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), text)

    out = docs.mapInArrow(released(run), docs.schema)
    if "n_chars" not in docs.columns:
        return out
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
