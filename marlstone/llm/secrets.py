"""Secret scans: patterns, and a battery of randomness tests with false-discovery control by length.

Patterns give the base spans. The method adds strings that look like encoded random bytes: a candidate is a run of 20 or
more characters of the usual encodings, other than digits alone, cut at ``=``; its alphabet is inferred from the characters it
has. Runs that no alphabet holds are taken apart at ``/``, ``-`` and ``_``, and of paths the parts are candidates beside the whole.
Three tests measure how far a candidate is from uniform draws of its alphabet: chi-squared over bins of symbols, Wald and
Wolfowitz's runs about the middle, and the serial correlation at lag 1. Fisher's method joins their p-values; random
strings have evenly spread ones, ordinary text has them near zero.

What share of ordinary strings passes is measured, not assumed: for each alphabet and length class of which there are
candidates, the whole text of every document is cut into decoys, names made of its words, that are judged by the same tests.
The cut-off of such a stratum is the least p at which decoys that pass, scaled to the number of candidates, are at most RATE of
the candidates that pass. So the longer a string is, the more it takes for ordinary ones to pass, and the lower the cut-off.

Nulls: a null text is empty. Repeated rows are scanned alike. Whole texts are scanned, however long. An empty table gives an
empty result. Ties in p fall on the same side of a cut-off. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import importable, let, materialize

#: The base patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+_-]{20,}={0,2}"), re.compile(r"[A-Za-z0-9]{20,}={0,2}")
#: Alphabets, in the order in which they are tried; a symbol's value is its place.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: Least lengths of the length classes.
LENGTHS = (20, 26, 34, 44, 60, 90)
RATE = 0.01
BINS = 1000
#: Texts of which decoys are judged at a time.
TEXTS = 32


#: Of each alphabet, the value of each Latin-1 character: its own, that of its other case, or one that stands for it.
_FOLDED = {name: np.array([of.get(c, of.get(c.upper(), of.get(c.lower(), i % len(of)))) for i, c in enumerate(map(chr, range(256)))]) for name, of in _VALUES.items()}
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def batteries(values: np.ndarray, size: int) -> np.ndarray:
    """For rows of symbols 0 to size - 1, the joint p-values of the three tests; small if a row is not like uniform draws."""
    m, n = values.shape
    bins = max(2, min(size, n // 5))
    seen = np.bincount((np.arange(m)[:, None] * bins + values * bins // size).reshape(-1), minlength=m * bins).reshape(m, bins)
    expected = np.array([n * (-(-(b + 1) * size // bins) - -(-b * size // bins)) / size for b in range(bins)])
    chi2, df = ((seen - expected) ** 2 / expected).sum(axis=1), bins - 1
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    uniform = 0.5 * _erfc(z / math.sqrt(2)).astype(float)
    high = 2 * values >= size
    n1 = high.sum(axis=1)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = _two_sided((1 + (high[:, 1:] != high[:, :-1]).sum(axis=1) - mean) / np.sqrt(np.where(var > 0, var, 1)))
    runs = np.where((n1 == 0) | (n1 == n), 0.5 ** (n - 1), np.where(var > 0, runs, 1.0))
    off = values - values.mean(axis=1, keepdims=True)
    spread = (off**2).sum(axis=1)
    serial = _two_sided(((off[:, 1:] * off[:, :-1]).sum(axis=1) / np.where(spread > 0, spread, 1) + 1 / n) * math.sqrt(n))
    serial = np.where(spread > 0, serial, 0.0)
    x = -sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, runs, serial))
    return np.exp(-x) * (1 + x + x * x / 2)


def battery(values: list[int], size: int) -> float:
    """Of one row."""
    return float(batteries(np.array([values]), size)[0])


def encoding(token: str) -> str | None:
    """The first alphabet that has all characters of the token, without padding at its end; none for digits alone."""
    chars = set(token.rstrip("="))
    if all(c.isdigit() for c in chars):
        return None
    return next((name for name, of in _VALUES.items() if chars <= of.keys()), None)


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), sorted."""
    low = text.lower()
    out = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float, int | None]]:
    """(start, end, stratum, p, start of the candidate that it is a part of) of candidates that do not meet a base span."""
    out = []

    def judge(at: int, token: str, depth: int, whole: int | None) -> None:
        name, body = encoding(token), token.rstrip("=")
        if name and len(body) >= LENGTHS[0] and not any(s < at + len(token) and at < e for s, _, e in base):
            of = _VALUES[name]
            out.append((at, at + len(token), f"{name}/{length_class(len(body))}", battery([of[c] for c in body], len(of)), whole))
            whole = at if whole is None else whole
        if depth < len(PART) and (not name or depth == 0 and "/" in token):
            for m in PART[depth].finditer(token):
                if m.end() - m.start() < len(token) or not name:
                    judge(at + m.start(), m[0], depth + 1, whole if name else None)

    for m in CANDIDATE.finditer(text):
        judge(m.start(), m[0], 0, None)
    return out


def decoys(texts: list[str], strata: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """For each stratum the p-values of the ordinary strings of that length that whole texts make.

    They are made as names are made: words one after the other, some with a capital, a number after every third where the alphabet
    has digits, and an underscore between where it has one. Characters that the alphabet lacks are folded into it.
    """
    cased = [[w.capitalize() if i % 3 == 1 else w.lower() for i, w in enumerate(t.split())] for t in texts]
    lines: dict[tuple[bool, bool], list[np.ndarray]] = {}
    for stratum in strata:
        name, kind = stratum.split("/")
        of, n = _VALUES[name], LENGTHS[int(kind)]
        how = ("0" in of or "7" in of, "_" in of)
        if how not in lines:
            parts = [[x for i, w in enumerate(ws) for x in ((w, str(ord(w[0]) * 7919 % 10_000)) if i % 3 == 2 else (w,))] for ws in cased] if how[0] else cased
            lines[how] = [np.frombuffer(("_" if how[1] else "").join(p).encode("latin-1", "replace"), np.uint8) for p in parts]
        rows = np.concatenate([x[: len(x) // n * n] for x in lines[how]]).reshape(-1, n)
        if len(rows):
            yield stratum, batteries(_FOLDED[name][rows], len(of))


def cutoffs(counts: dict[tuple[str, int], tuple[int, int]]) -> dict[str, float]:
    """Counts of candidates and decoys by (stratum, bin of p) to the least p that passes in each stratum; 2 where none does."""
    out = {}
    for stratum in sorted({s for s, _ in counts}):
        own = [counts.get((stratum, b), (0, 0)) for b in range(BINS + 1)]
        all_c, all_d = (sum(x[i] for x in own) for i in (0, 1))
        c = d = 0
        out[stratum] = 2.0
        for b in range(BINS, -1, -1):
            c, d = c + own[b][0], d + own[b][1]
            if c and (d + 1) / (all_d + 1) * all_c <= RATE * c:
                out[stratum] = b / BINS
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    span = "array<struct<start: int, place: int, end: int, stratum: string, p: double, whole: int>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                spans.append([{"start": s, "place": k, "end": e, "stratum": None, "p": None, "whole": None} for s, k, e in base] + [{"start": s, "place": 3, "end": e, "stratum": of, "p": p, "whole": w} for s, e, of, p, w in candidates(t, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("p", pa.float64()), ("whole", pa.int32())])))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    looked = docs.select(F.col(doc_id), F.col(text)).mapInArrow(look, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {span}")
    known = materialize(looked, "secrets")
    tried = known.select(F.explode(F.filter("found", lambda x: x["p"].isNotNull())).alias("x")).groupBy(F.col("x.stratum").alias("stratum"), F.floor(F.col("x.p") * BINS).cast("int").alias("bin")).count()
    counts = {(r["stratum"], r["bin"]): (r["count"], 0) for r in tried.collect()}  # strata * (BINS + 1) at most
    strata = sorted({s for s, _ in counts})

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {s: np.zeros(BINS + 1, np.int64) for s in strata}
            for at in range(0, batch.num_rows, TEXTS):
                for stratum, p in decoys([t or "" for t in batch.column(0).slice(at, TEXTS).to_pylist()], strata):
                    seen[stratum] += np.bincount((p * BINS).astype(np.int64), minlength=BINS + 1)[: BINS + 1]
            rows = [(s, b, int(n)) for s, of in seen.items() for b, n in enumerate(of) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["stratum", "bin", "n"])

    if strata:
        made = docs.select(F.col(text)).mapInArrow(ordinary, "stratum string, bin int, n bigint").groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
        for r in made.collect():  # the same
            k = (r["stratum"], r["bin"])
            counts[k] = (counts.get(k, (0, 0))[0], r["n"])
    least = cutoffs(counts)
    passes = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map(F.lit(""), F.lit(2.0))
    good = F.filter("found", lambda x: x["p"].isNull() | (x["p"] >= F.coalesce(F.element_at(passes, x["stratum"]), F.lit(2.0))))
    kept = let(good, lambda all_: F.filter(all_, lambda x: x["whole"].isNull() | ~F.exists(all_, lambda y: (y["place"] == 3) & y["whole"].isNull() & (y["start"] == x["whole"]))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text_of = F.array_join(F.transform(F.sort_array("kept"), lambda x: F.concat_ws(":", F.get(names, x["place"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return known.withColumn("kept", kept).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text_of.alias("spans"), F.size(F.filter("kept", lambda x: x["place"] == 3)).cast("long").alias("n_random"))
