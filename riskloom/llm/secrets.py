"""Secret scans: credential patterns, and sliding-window Shannon entropy over candidate strings.

Patterns give the kinds assign, access and hex. The entropy scan takes every run of credential characters, splits it by
character class (hex, alphanumeric, base64), slides a window over it while keeping the window's symbol counts up to date, and
marks the windows whose entropy passes the class's threshold. An allow-list lets through identifiers that are random-looking
but public (UUIDs), numbers, and words with counters; mixed case that is no joined words, and entropy that words don't reach,
win over it. Of an entropy span what a pattern has already taken is cut out, the rest stays. Spans are in code points, the end
exclusive.

Defined cases: null and empty texts have no spans; repeated rows each get a row; an empty table gives an empty result; extra
columns are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read_table, text_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of maximal runs only those this long count, and a shorter run holds no longer one
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Class, its alphabet, bits of entropy from which a window counts. Tried in order; the first that covers the run is used.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 2.9),
    ("alnum", re.compile(r"[0-9A-Za-z]+"), 3.55),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]+"), 3.75),
)
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
NUMBERS = re.compile(r"[0-9_/=+-]*")  # numbers, dates, rules
SEPARATORS = re.compile(r"[/_=+-]+")
#: A part of a run that is a word of one case, or words joined by capitals, with a short number behind.
WORD = re.compile(r"(?:[A-Z]*|[A-Z]?[a-z]*|[a-z]+(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+)[0-9]{0,4}")
RANDOM = 3.9  # bits from which a window inside one part counts, word or not

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def high_entropy_windows(run: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of a run with at least threshold bits a symbol. Counts change by one symbol in and one out at each step."""
    n = len(run)
    if n < window:
        return []
    weight = [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 2)]  # a symbol comes in before one goes
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, symbol in enumerate(run):
        c = counts.get(symbol, 0)
        counts[symbol] = c + 1
        total += weight[c + 1] - weight[c]
        if i >= window:
            gone = run[i - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += weight[c - 1] - weight[c]
        if i >= window - 1 and math.log2(window) - total / window >= threshold - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def is_allowed(run: str) -> bool:
    """Whether a run is public or made of words and numbers. Each part between separators is looked at once, so time is linear."""
    if UUID.fullmatch(run) or NUMBERS.fullmatch(run):
        return True
    parts = SEPARATORS.split(run)
    return all(map(WORD.fullmatch, parts)) and not any(high_entropy_windows(part, RANDOM) for part in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def outside(spans: list[tuple[int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What is left of ascending spans without those taken, which are sorted by start."""
    found, k = [], 0
    reach: list[tuple[int, int]] = []  # the taken ones, those that meet as one
    for _, s, e in taken:
        if reach and s <= reach[-1][1]:
            reach[-1] = (reach[-1][0], max(e, reach[-1][1]))
        else:
            reach.append((s, e))
    for start, end in spans:
        while k < len(reach) and reach[k][1] <= start:
            k += 1
        j = k
        while j < len(reach) and reach[j][0] < end:
            if start < reach[j][0]:
                found.append((start, reach[j][0]))
            start = reach[j][1]
            j += 1
        if start < end:
            found.append((start, end))
    return found


def entropy_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """High-entropy spans, without what is already taken (sorted by start)."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if is_allowed(run):
            continue
        threshold = next(bits for _, alphabet, bits in CLASSES if alphabet.fullmatch(run))
        found += [(m.start() + start, m.start() + end) for start, end in high_entropy_windows(run, threshold)]
    return [("entropy", start, end) for start, end in outside(found, taken)]


def find_spans(text: str) -> tuple[list, list]:
    """Base spans and all spans, each by start and then kind."""
    order = lambda span: (span[1], KINDS.index(span[0]))
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + entropy_spans(text, base), key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches):
        rows = [find_spans(text) for text in texts]
        counts = [[sum(s[0] == kind for s in spans) for _, spans in rows] for kind in KINDS]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([joined(spans) for _, spans in rows], pa.string()), pa.array(counts[3], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, RESULT)


def redact(text: str, mask: str = "[secret]") -> str:
    """The text with every span replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for _, start, end in find_spans(text)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, with the secrets in text_col masked. All rows, columns and null texts stay."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t) for t in batch.column(position).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == position else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
