"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

A token of 20 or more characters of the base64 alphabets that mixes letters and digits is a candidate. Its encoding
is inferred: the smallest of the alphabets below that holds all its characters. Three statistics are taken: chi-squared of
uniformity over the alphabet (few cells: the alphabet is folded to as many cells as the length can fill), the serial
correlation of neighbouring symbols, and the number of runs of small letters, capitals, digits and marks. Each is tested
against ordinary text, a chain of classes that changes at a low rate and draws letters as often as English has them: how
likely is it that ordinary text of this length and alphabet looks so random? Their normal scores are added, as of tests with a
correlation of TESTS_ALIKE, to one p-value for each candidate. A candidate that random draws themselves would hardly give
(FIT_LEVEL, by uniformity or by correlation) is no candidate.

False discoveries: tests of longer tokens are stronger, so candidates fall into length classes and each class has its own
Benjamini-Hochberg threshold over all candidates of the corpus, from a histogram of fixed size of their p-values.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import map_batches, materialize, text_or_empty

KINDS = ("assign", "access", "hex", "random")
#: The words and shapes of the base patterns. ASCII letters of the words in either case.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits is a match as a whole, so asking for 16 at once finds what [0-9a-f]+ of 16 or more finds.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets by size, as Python classes.
ENCODINGS = tuple((name, re.compile(f"[{chars}]+=*").fullmatch, size) for name, chars, size in (("hex", "0-9a-f", 16), ("hex_upper", "0-9A-F", 16), ("base32", "A-Z2-7", 32), ("base36", "0-9a-z", 36), ("base36_upper", "0-9A-Z", 36), ("base62", "0-9A-Za-z", 62), ("base64", "0-9A-Za-z+/", 64), ("base64_url", "0-9A-Za-z_-", 64)))
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Their symbols in order of rank.
_SYMBOLS = {"hex": _DIGITS + _LOWER[:6], "hex_upper": _DIGITS + _UPPER[:6], "base32": _UPPER + _DIGITS[2:8], "base36": _DIGITS + _LOWER, "base36_upper": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _DIGITS + _UPPER + _LOWER + "+/", "base64_url": _DIGITS + _UPPER + _LOWER + "-_"}
_RANKS = {name: {c: i for i, c in enumerate(symbols)} for name, symbols in _SYMBOLS.items()}
#: Rate at which neighbouring characters of ordinary identifiers change class; level of the fit tests; of false discoveries;
#: correlation that the tests are taken to have; the largest normal score of one test.
CHANGE_RATE, FIT_LEVEL, FDR, TESTS_ALIKE, MOST_SCORE = 0.12, 1e-3, 0.01, 0.5, 8.0
#: Shares of small letters, capitals, digits and marks in ordinary identifiers. How often English has a to z, in percent.
SHARES = (0.78, 0.08, 0.12, 0.02)
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
#: Lower ends of the length classes; bins of -log10 p, so many to one; the most bins.
LENGTHS, PER_DECADE, BINS = (20, 32, 48, 80), 4, 160


_NORMAL = NormalDist()


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared of df degrees > x), by the Wilson-Hilferty cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at least k of n), summed from the largest term on."""
    if k <= 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, n + 1):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        if term < total * 1e-12:
            break
    return min(1.0, total)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=None)
def _ordinary(encoding: str) -> tuple[np.ndarray, float]:
    """Of an alphabet in ordinary text: how often each symbol occurs, and the correlation of neighbours."""
    symbols = _SYMBOLS[encoding]
    kinds = np.array([_class(c) for c in symbols])
    often = np.array([LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1.0 for c in symbols])
    share = np.zeros(len(symbols))
    for k in set(kinds.tolist()):
        share[kinds == k] = SHARES[k] * often[kinds == k] / often[kinds == k].sum()
    share /= share.sum()
    rank, weight = np.arange(len(symbols)), np.array([share[kinds == k].sum() for k in range(4)])
    mean = float(share @ rank)
    between = sum(w * (float(share[kinds == k] @ rank[kinds == k]) / w - mean) ** 2 for k, w in enumerate(weight) if w)
    stays = max(0.0, 1 - CHANGE_RATE / max(1e-9, 1 - float(weight @ weight)))
    return share, stays * between / float(share @ (rank - mean) ** 2)


@lru_cache(maxsize=None)
def _cells(encoding: str, cells: int) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Of an alphabet folded to cells: the share of each in random draws, and mean and variance of chi-squared in ordinary
    text, each as a constant and what every symbol adds."""
    share = _ordinary(encoding)[0]
    of = np.arange(len(share)) * cells // len(share)
    # where cells doesn't divide the alphabet, some cells hold a symbol more than others
    u, q = np.bincount(of, minlength=cells) / len(share), np.bincount(of, share, cells)
    far = (q - u) / u
    return tuple(u.tolist()), (float((q * (1 - q) / u).sum()), float((far * (q - u)).sum())), (2.0 * (cells - 1), 4 * float(q @ far**2 - (q @ far) ** 2))


def _z(p: float) -> float:
    """The normal score of an upper tail."""
    return MOST_SCORE if p <= 0 else min(MOST_SCORE, -_NORMAL.inv_cdf(min(max(p, 1e-300), 1 - 1e-16)))


def battery(token: str) -> tuple[float, float, float] | None:
    """Normal scores of a candidate against ordinary text (larger: more random), by uniformity, serial correlation and runs;
    None where it is no candidate or random draws would hardly give it."""
    body = token.rstrip("=")
    classes = [_class(c) for c in body]
    if 2 not in classes or not ({0, 1} & set(classes)):
        return None
    found = next((x for x in ENCODINGS if x[1](token)), None)
    if found is None:
        return None
    name, size, n = found[0], found[2], len(body)
    # symbols by rank within the alphabet, folded to as many cells as give 5 draws each on average
    rank = [_RANKS[name][c] for c in body]
    cells = max(2, min(size, n // 5))
    counts = [0] * cells
    for r in rank:
        counts[r * cells // size] += 1
    random, mean_of, variance = _cells(name, cells)
    chi2 = sum((c - n * u) ** 2 / (n * u) for c, u in zip(counts, random, strict=True))
    if chi2_tail(chi2, cells - 1) < FIT_LEVEL:
        return None
    mean = sum(rank) / n
    around = sum((r - mean) ** 2 for r in rank)
    serial = sum((a - mean) * (b - mean) for a, b in zip(rank, rank[1:], strict=False)) / around if around else 1.0
    if math.erfc(abs(serial) * math.sqrt(n) / math.sqrt(2)) < FIT_LEVEL:
        return None
    uniform = (mean_of[0] + n * mean_of[1] - chi2) / math.sqrt(variance[0] + n * variance[1])
    unlike = (_ordinary(name)[1] - serial) * math.sqrt(n)
    runs = _z(binomial_tail(sum(a != b for a, b in zip(classes, classes[1:], strict=False)), n - 1, CHANGE_RATE))
    return tuple(max(-MOST_SCORE, min(MOST_SCORE, z)) for z in (uniform, unlike, runs))


def randomness(token: str) -> float | None:
    """The p-value of a candidate under ordinary text, from all tests together, or None where it is none."""
    z = battery(token)
    if z is None:
        return None
    k = len(z)
    return 0.5 * math.erfc(sum(z) / math.sqrt(k + k * (k - 1) * TESTS_ALIKE) / math.sqrt(2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; kinds as numbers of KINDS."""
    low = text.lower()
    spans = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the p-value) of the tokens beside the base spans that look random."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in taken):
            continue
        p = randomness(m[0])
        if p is not None:
            out.append((a, b, sum(b - a >= x for x in LENGTHS) - 1, min(BINS, int(-math.log10(max(p, 1e-300)) * PER_DECADE))))
    return out


def thresholds(histogram: dict[tuple[int, int], int], fdr: float = FDR) -> dict[int, int]:
    """For each length class the smallest bin that Benjamini-Hochberg rejects at: with m candidates, the bin's largest
    p-value times m is at most fdr times the candidates in this bin and those above."""
    found = {}
    for k in range(len(LENGTHS)):
        m = sum(n for (c, _), n in histogram.items() if c == k)
        above = 0
        for b in range(BINS, 0, -1):
            above += histogram.get((k, b), 0)
            if above and 10 ** (-b / PER_DECADE) * m <= fdr * above:
                found[k] = b
    return found


_SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,length:int,bin:int>>, base_sha256 string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, random-looking candidates and base_sha256 of each row of docs; no decision yet."""
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("bin", pa.int32())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, found, digest = [], [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found.append([{"start": s, "end": e, "length": c, "bin": b} for s, e, c, b in candidates(text, spans)])
            digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(found, found_type), pa.array(digest)], ["doc_id", "base", "found", "base_sha256"])

    return map_batches(text_or_empty(docs), lambda: step, _SCANNED)


def corpus_thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Over all candidates of a materialized scan; the histogram has at most len(LENGTHS) * (BINS + 1) cells."""
    cells = scanned.select(F.explode("found").alias("c")).groupBy("c.length", "c.bin").count().collect()
    return thresholds({(r["length"], r["bin"]): r["count"] for r in cells}, fdr)


def spans(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base_sha256 and spans, an array of (start, kind, end) by start and kind, of each row of docs.

    Positions are code points, end exclusive; whole texts are scanned, however long. A null text counts as an empty one; repeated
    rows and null doc_ids keep their rows; spans of two kinds that start together stand in the order of KINDS; a token whose
    p-value ties with the threshold is a secret. An empty table gives an empty table, and a table without candidates has base
    spans alone. Other columns are ignored, whatever they are called.
    """
    scanned = materialize(scan(docs), "secrets")
    least = corpus_thresholds(scanned, fdr)
    passes = F.lit(False)
    cell = lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))
    if least:
        table = F.create_map(*[F.lit(v) for kv in least.items() for v in kv])
        passes = lambda x: F.coalesce(x["bin"] >= F.element_at(table, x["length"]), F.lit(False))
        more = F.transform(F.filter("found", passes), cell)
        return scanned.select("doc_id", "base_sha256", F.array_sort(F.concat("base", more)).alias("spans"))
    return scanned.select("doc_id", "base_sha256", F.col("base").alias("spans"))


def report(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """spans() as counts by kind and one string."""
    named = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans(docs, fdr).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", F.array_join(F.transform("spans", one), ",").alias("spans"), count(3).alias("n_random"))


def redact(docs: DataFrame, fdr: float = FDR, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mask and n_chars, where docs has it, brought up to date.

    The thresholds come from a scan of all rows first; the second pass finds the spans again from the text, so no text
    is joined or shuffled. Every row stays, by its own text alone: repeated and null doc_ids make no difference; a null text
    stays null, an empty one empty, and very long texts are masked to their end. Spans that overlap leave one mask. An empty table
    gives an empty table.
    """
    least = corpus_thresholds(materialize(scan(docs).select("found"), "candidates"), fdr)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            if text:
                found = base_spans(text)
                found = sorted([(s, e) for s, _, e in found] + [(s, e) for s, e, c, b in candidates(text, found) if b >= least.get(c, BINS + 1)])
                if found:
                    parts, at = [], 0
                    for s, e in found:
                        if s >= at:
                            parts += [text[at:s], mask]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
            out.append(text)
        i = batch.schema.get_field_index("text")
        return batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    clean = map_batches(docs, lambda: step, docs.schema)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
