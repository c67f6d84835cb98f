"""Secret scans: fixed patterns, and a battery of randomness tests over every long token of a text."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from . import texts

MIN_TOKEN = 20  # characters of the shortest token the battery tests
FALSE_DISCOVERIES = 0.05  # share of reported tokens that may be no random ones
BINS = 100  # bins of the histogram of p-values
LEVEL = 0.05  # level of the tests that a stratum's tokens hold more false ones than the rate allows
EXACT = 1_000  # tokens up to which binomial tails are summed, not approximated

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

# Alphabets a token's encoding is inferred from, narrowest first.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_NAMES = list(ENCODINGS)
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


def _members(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_HEX = _members(ENCODINGS["hex"])
_TOKEN = _members(ENCODINGS["base64"] + "-_")
_WITHIN = [_members(ENCODINGS["base64"]), _members(ENCODINGS["base64url"]), _members(ENCODINGS["base64"].replace("/", ""))]


def _runs(data: np.ndarray, members: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of member bytes of at least ``least`` bytes."""
    inside = np.concatenate(([False], members[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def chi_squared_tail(x: float, degrees: int) -> float:
    """P(X >= x) of a chi-squared variable with a whole number of degrees of freedom."""
    half = x / 2
    if degrees % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total)
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
    for i in range((degrees - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, math.erfc(math.sqrt(half)) + math.exp(-half) * total)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: list[int], size: int) -> float:
    """p-value of the chi-squared test that symbols are uniform; symbols are pooled so each cell expects at least four."""
    n = len(values)
    cells = max(2, min(size, n // 4))
    edges = [math.ceil(i * size / cells) for i in range(cells + 1)]
    observed = [0] * cells
    for v in values:
        observed[v * cells // size] += 1
    statistic = sum((o - n * (b - a) / size) ** 2 / (n * (b - a) / size) for o, a, b in zip(observed, edges[:-1], edges[1:]))
    return chi_squared_tail(statistic, cells - 1)


def runs(values: list[int], size: int) -> float:
    """p-value of the runs test: how often do symbols change between the lower and the upper half of the alphabet?"""
    upper = [2 * v >= size for v in values]
    a = sum(upper)
    b = len(upper) - a
    if a == 0 or b == 0:
        return _two_sided(math.sqrt(len(upper)))
    n = a + b
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    changes = 1 + sum(x != y for x, y in zip(upper, upper[1:]))
    return 1.0 if variance <= 0 else _two_sided((changes - mean) / math.sqrt(variance))


def serial_correlation(values: list[int]) -> float:
    """p-value of the correlation between neighbouring symbols."""
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread == 0:
        return 0.0
    products = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:]))
    return _two_sided((products / spread + 1 / n) * math.sqrt(n))


def battery(token: str) -> tuple[int, float] | None:
    """(inferred encoding, combined p-value that the token is random in it), or None if no alphabet holds the token."""
    body = token.rstrip("=")
    for code, name in enumerate(_NAMES):
        index = _INDEX[name]
        if all(c in index for c in body):
            values = [index[c] for c in body]
            size = len(index)
            each = (uniformity(values, size), runs(values, size), serial_correlation(values))
            fisher = -2 * sum(math.log(max(p, 1e-300)) for p in each)
            return code, chi_squared_tail(fisher, 6)
    return None


def candidates(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte runs the battery tests: whole runs of token characters, and in them the longest runs of the base64 alphabet, of
    the base64url alphabet, and between the signs that also join words, so a key behind a path or a label is tested alone."""
    found = set()
    for s, e in _runs(data, _TOKEN, MIN_TOKEN):
        found.add((s, e))
        for members in _WITHIN:
            found.update((s + a, s + b) for a, b in _runs(data[s:e], members, MIN_TOKEN))
    return sorted(found)


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without those that overlap a longer one."""
    chosen: list[tuple[int, int, int]] = []
    for s, e, k in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        at = bisect.bisect(chosen, (s, e, k))
        if (at == 0 or chosen[at - 1][1] <= s) and (at == len(chosen) or e <= chosen[at][0]):
            chosen.insert(at, (s, e, k))
    return chosen


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, ends exclusive, in code points."""
    found = []
    lower = data.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    view = np.frombuffer(data, np.uint8)
    runs = _runs(view, _HEX, MIN_HEX)
    found += [(*span, 2) for span in _points(text, data, runs)]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def _points(text: str, data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets of ASCII runs at byte offsets; lead bytes are counted once for all runs."""
    if len(text) == len(data) or not runs:
        return list(runs)
    before = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
    starts = [int(before[s]) - 1 for s, _ in runs]  # a run starts on a lead byte, which its own count includes
    return [(at, at + e - s) for at, (s, e) in zip(starts, runs)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _stratum(code: int, length: int) -> int:
    """Encoding and length class (doubling): p-values of short and long tokens are never pooled."""
    return code * 16 + min(15, int(math.log2(length / MIN_TOKEN)) if length > MIN_TOKEN else 0)


def _signed(token: bytes) -> int:
    """Hash of a token as a signed number: copies of a token say no more about the p-values than one of them."""
    value = xxhash.xxh64_intdigest(token)
    return value - 2**64 if value >= 2**63 else value


def _scan(documents: DataFrame) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "starts", "ends", "kinds", "token_starts", "token_ends", "strata", "bins", "tokens")
        out: dict[str, list] = {name: [] for name in names}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            spans = base_spans(text, data)
            judged = [(s, e, result) for s, e in candidates(np.frombuffer(data, np.uint8)) if (result := battery(data[s:e].decode())) is not None]
            places = _points(text, data, [(s, e) for s, e, _ in judged])
            tested = [
                (*place, _stratum(code, e - s), min(BINS - 1, int(p * BINS)), _signed(data[s:e])) for place, (s, e, (code, p)) in zip(places, judged)
            ]
            kinds = [k for _, _, k in spans]
            values = (
                doc, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(spans).encode()).hexdigest(),
                [s for s, _, _ in spans], [e for _, e, _ in spans], kinds, *([t[i] for t in tested] for i in range(5)),
            )
            for name, value in zip(names, values):
                out[name].append(value)
        yield out

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, starts array<int>, ends array<int>, "
        "kinds array<int>, token_starts array<int>, token_ends array<int>, strata array<int>, bins array<int>, "
        "tokens array<long>"
    )
    return texts.map_batches(documents.select(F.col("doc_id").cast("long"), "text"), kernel, schema)


def binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k) of n draws with chance p: summed for few draws, by the normal curve for many."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    if n > EXACT:
        return math.erfc((k - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p))) / 2
    whole = math.lgamma(n + 1)
    terms = (whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1))
    return min(1.0, sum(map(math.exp, terms)))


def thresholds(histogram: dict[int, dict[int, int]], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the lowest bin of p-values that is reported; strata where nothing can be reported are left out.

    P-values of random tokens are uniform, those of words pile up at the low end of every range.  Bins from b up may be
    reported if their tokens agree with that: of n tokens at most ``rate`` (rounded down) are false, the others uniform.
    No range may then hold more at its low end than these false ones and a binomial share of the others; every split of the
    range is tested, all together at ``LEVEL``, with exact tails for few tokens.  The lowest b that no split speaks against is taken.  A
    token alone in its stratum is reported from p = ``LEVEL`` up; so few tokens cannot show their share of false ones.
    """
    chosen = {}
    for stratum, counts in histogram.items():
        filled = sorted(b for b, n in counts.items() if n)
        for b in range(filled[-1] + 1 if filled else 0):
            n = sum(counts[x] for x in filled if x >= b)
            false, low, agrees = int(rate * n), 0, True
            level = LEVEL / max(1, sum(b <= x < BINS - 1 for x in filled))
            for x in filled:
                if x >= b and agrees and x + 1 < BINS:
                    low += counts[x]
                    agrees = binomial_tail(n - false, (x + 1 - b) / (BINS - b), low - false) >= level
            if agrees:
                chosen[stratum] = b
                break
    return chosen


def scan(documents: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random.

    The fixed patterns give spans of kinds assign, access and hex.  Every run of 20 or more token characters is tested as
    well, whole if one alphabet holds it, and its longest runs in one alphabet or between joining signs: in the narrowest
    alphabet, are the symbols uniform, do they change halves as often as chance has it, are neighbours uncorrelated?
    Tokens that pass at the false-discovery ``rate`` of their encoding and length class are spans of kind random; of spans
    that overlap the longest stays.  The p-values' histogram over all different tokens (at most 8,000 counts) sets the thresholds.
    Null text counts as empty: no spans, empty strings' digest.  Repeated rows and rows without doc_id come back as given;
    other columns are ignored; an empty table gives an empty result.
    """
    scanned = cut_lineage(_scan(documents))
    distinct = scanned.select(F.explode(F.arrays_zip("strata", "bins", "tokens")).alias("t")).select("t.*").distinct()
    pairs = distinct.groupBy("strata", "bins").count()
    histogram: dict[int, dict[int, int]] = {}
    for row in pairs.collect():
        histogram.setdefault(row["strata"], {})[row["bins"]] = row["count"]
    lowest = thresholds(histogram, rate)

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = batch.to_pylist()
        spans, n_random = [], []
        for r in rows:
            base = list(zip(r["starts"], r["ends"], r["kinds"]))
            random = [
                (s, e, 3) for s, e, stratum, b in zip(r["token_starts"], r["token_ends"], r["strata"], r["bins"]) if b >= lowest.get(stratum, BINS)
            ]
            random = apart(random)
            spans.append(joined(base + random))
            n_random.append(len(random))
        yield {name: batch.column(name) for name in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")} | {"spans": spans, "n_random": n_random}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return texts.map_batches(scanned, kernel, schema)
