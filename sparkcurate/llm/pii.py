"""Personal data by weak supervision.

Candidates are spans of a form that personal data may have. Labelers vote on each: strict forms and
check digits (regex), lists of known endings, issuers and words (gazetteer), and the words in front of it
(context); they say yes, no or nothing. Expectation-maximisation estimates from all votes of
all documents how often each labeler is right for each kind, with no labelled span at all. Its verdicts,
as probabilities, train a logistic regression on the votes and the shape of the span, which
decides. Both are fitted on counts of equal vote and shape patterns: a bounded table, however
many documents there are.

The four base kinds are found by their definitions and always stay; the method adds spans that
overlap none of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, map_texts
from sparkcurate.session import materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "ssn", "ip6")
KINDS = BASE + ADDED

_TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)

# The definitions of the base kinds. Email is anchored at its @, see base_spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CANDIDATES = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[\w-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]{2,63}){1,3}", re.I)),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
)

# Lists of the labelers.
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co example".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xox", "AKIA", "ASIA", "AIza", "eyJ", "glpat-")
WORDS = {
    "email": ("mail", "contact", "write", "@"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "key", "secret", "passw", "pwd", "bearer", "auth", "credential"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
    "ip6": ("ip", "address", "host"),
}
AGAINST = ("version", "isbn", "issn", "doi", "sha", "commit", "checksum", "md5", "hash", "uuid", "page", "http")
CONTEXT_CHARS = 32
LABELERS = ("form", "check", "gazetteer", "context", "against", "variety")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then start; leftmost, not overlapping within a kind.

    Every step is linear in the text: an email is looked for from its @ backwards, and a chain
    of dotted numbers is cut by fours.
    """
    spans, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append(("email", start, m.end()))
                end = m.end()
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".") if m.group().count(".") >= 3 else ()
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                spans.append(("ip", at, stop))
            at = stop + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(value: str) -> bool:
    moved = value.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes(kind: str, value: str, before: str) -> tuple[int, ...]:
    """One vote per labeler: 1 yes, -1 no, 0 nothing."""
    digits = [c for c in value if c.isdigit()]
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), bool(digits)))
    form = {
        "email": 1,
        "phone": 1 if value[0] == "(" else 0,
        "secret": 1 if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9_-]{32,}", value) else 0,
        "iban": 1 if 15 <= len(value.replace(" ", "")) <= 34 else -1,
        "ssn": -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1,
        "ip6": 1,
    }[kind]
    check = {"iban": lambda: 1 if _mod97(value) else -1}.get(kind, lambda: 0)()
    gazetteer = {
        "email": lambda: 1 if re.split(r"[^a-z]+", value.lower().rstrip(")] "))[-1] in ENDINGS else -1,
        "iban": lambda: 1 if value[:2] in COUNTRIES else -1,
        "secret": lambda: 1 if value.startswith(PREFIXES) else 0,
    }.get(kind, lambda: 0)()
    near = before.lower()
    context = 1 if any(w in near for w in WORDS[kind]) else 0
    against = -1 if any(w in near for w in AGAINST) else 0
    distinct = len(set(value))
    variety = -1 if distinct <= 3 or kind == "secret" and (kinds < 2 or len(digits) < 4) else 1 if distinct >= 8 else 0
    return form, check, gazetteer, context, against, variety


def shape(value: str, before: str) -> tuple[int, ...]:
    """Small whole numbers that describe a span: length, share of digits, a quote or sign before it."""
    digits = sum(c.isdigit() for c in value)
    return min(len(value) // 8, 6), 4 * digits // len(value), int(before[-1:] in ("'", '"')), int("=" in before[-4:] or ":" in before[-4:])


def _disjoint(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that the spans cover, in order; overlapping spans become one."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple]:
    """kind, start, end, votes, shape of spans that overlap nothing taken, the first form to match winning."""
    starts, ends = _disjoint((a, b) for _, a, b in taken)
    for kind, pattern in _CANDIDATES:
        fresh = []
        for m in pattern.finditer(text):
            a, b = m.span()
            # Of disjoint places only the last one that begins before the end can reach into the span.
            i = bisect_left(starts, b)
            if i and ends[i - 1] > a:
                continue
            before = text[max(0, a - CONTEXT_CHARS) : a]
            yield kind, a, b, votes(kind, m.group(), before), shape(m.group(), before)
            fresh.append((a, b))
        if fresh:
            starts, ends = _disjoint([*zip(starts, ends), *fresh])


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base (kind, start, end) and found (kind, start, end, pattern) of every whole text."""
    span = "kind: string, start: int, end: int"
    schema = f"key {arrow_type(docs, key)}, base array<struct<{span}>>, found array<struct<{span}, pattern: string>>"
    place = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    types = pa.list_(pa.struct(place)), pa.list_(pa.struct([*place, ("pattern", pa.string())]))

    def make():
        def one(value: str | None) -> tuple[list, list]:
            if not value or not _TRIGGER.search(value):
                return [], []
            base = base_spans(value)
            more = [
                (k, a, b, " ".join([k, *map(str, v), *map(str, s)])) for k, a, b, v, s in candidates(value, base)
            ]
            return base, more

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(t) for t in batch.column("text").to_pylist()]
            names = "kind", "start", "end", "pattern"
            columns = [
                pa.array([[dict(zip(names, s)) for s in f[i]] for f in found], types[i]) for i in range(2)
            ]
            return pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "base", "found"])

        return work

    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, schema)


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> np.ndarray:
    """Probability that each (kind, votes, count) is personal data, by expectation-maximisation.

    A labeler has, for each kind, chances of yes, no and nothing if the span is personal data and
    if it is not; a kind has a share. All start from: a labeler is right four times in five.
    """
    kinds = [p[0] for p in patterns]
    v = np.array([p[1] for p in patterns]) + 1
    n = np.array([p[2] for p in patterns], float)
    total = v.sum(axis=1) - v.shape[1]
    q = np.clip(0.5 + 0.2 * total, 0.05, 0.95)
    for _ in range(rounds):
        before = q.copy()
        for kind in set(kinds):
            rows = np.array([k == kind for k in kinds])
            weights = np.stack([n[rows] * (1 - q[rows]), n[rows] * q[rows]])
            share = (weights.sum(axis=1) + 1) / (n[rows].sum() + 2)
            logs = np.log(np.repeat(share[:, None], rows.sum(), axis=1))
            for j in range(v.shape[1]):
                # Pseudo-counts say that a vote is more often right than wrong.
                chances = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
                for c in range(2):
                    chances[c] += np.bincount(v[rows, j], weights=weights[c], minlength=3)
                chances /= chances.sum(axis=1, keepdims=True)
                logs += np.log(chances[:, v[rows, j]])
            q[rows] = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(q - before).max() < 1e-6:
            break
    return q


def _features(pattern: str) -> np.ndarray:
    kind, *numbers = pattern.split(" ")
    numbers = np.array(numbers, float)
    v = numbers[: len(LABELERS)]
    return np.concatenate([[1.0], [k == kind for k in KINDS], v > 0, v < 0, numbers[len(LABELERS) :] / 4])


def fit_classifier(patterns: list[str], target: np.ndarray, n: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on probabilities, by Newton steps with a small ridge."""
    x = np.stack([_features(p) for p in patterns])
    w, weight = np.zeros(x.shape[1]), np.log1p(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 0.1 * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> dict[str, bool]:
    """For every pattern of votes and shape that occurs whether its spans are personal data.

    The driver gets one row per pattern; their number is bounded by the labelers and shapes.
    """
    counted = (
        found.select(F.explode("found").alias("f")).groupBy(F.col("f.pattern").alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    )
    if not counted:
        return {}
    names = [r["pattern"] for r in counted]
    n = np.array([r["n"] for r in counted], float)
    split = [p.split(" ") for p in names]
    q = reliabilities([(s[0], tuple(map(int, s[1 : 1 + len(LABELERS)])), c) for s, c in zip(split, n)])
    w = fit_classifier(names, q, n)
    return {p: bool(_features(p) @ w >= 0) for p in names}


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans (arrays of kind, start, end in code points, end exclusive) of every row.

    A null text is empty. ``base`` comes by kind as listed, then start; ``spans`` has all of them
    and those added. One row per input row, repeated rows included; a null key stays null; an
    empty table gives an empty result; other columns are not read.
    """
    found = materialise(find_candidates(docs, key, text), "spans")
    accepted = sorted(p for p, yes in train(found).items() if yes)
    # Patterns are few, so the decision travels as a literal.
    good = F.filter("found", lambda f: f["pattern"].isin(accepted) if accepted else F.lit(False))
    added = F.transform(good, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        F.concat("base", added),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(
        F.sort_array(ranked),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select(F.col("key").alias(key), "base", spans.alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )
