"""Operator 3, personal data: base patterns, and gradient-boosted trees over more candidates.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. High-recall
generators propose looser spans of the same kinds, which may overlap: numbers with any
separators and with O or I among the digits, addresses written with (at) and (dot) or spaces,
dotted numbers. Boosted trees score each proposal by format and by the words around it.

They do not learn what the base patterns accept, but what they miss: each base span is written
again in another form at its place (variant: accepted) and as something that only looks like it
(lookalike: a failing checksum, a part over 255, a date or an amount, an @ between words), and all
proposals there, and those elsewhere that touch no base span, are examples. For each kind a
threshold, calibrated on all documents held out from the fit, selects further spans; a proposal
that overlaps a base span of any kind, or a better proposal, is not added.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate
from random import Random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import fields, save, tidy, whole

KINDS = ("email", "ip", "card", "phone")
#: The trees are fitted on the examples of at most so many documents (those of least hash of the id), and of these on so many of least hash at most.
SAMPLE_DOCS, SAMPLE_EXAMPLES = 20_000, 100_000
#: Every HOLD_OUT-th document (by a checksum of the id) calibrates the thresholds and is never fitted on.
HOLD_OUT = 4
TREES, DEPTH, LEARNING_RATE = 15, 4, 0.3
#: Of n held-out proposals at or above a kind's threshold, PRECISION * (n + 1) at least are accepted ones; a kind too rare to show that adds no spans.
PRECISION = 0.95
#: Bins of scores in the calibration; no threshold is below FLOOR.
BINS, FLOOR = 200, 0.5
#: Code points around a rewritten span that its examples see.
AROUND = 40

# Fixed patterns. Possessive runs and the lookbehind change no match; they keep long digit runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPELLED = re.compile(r"\(at\)|\[at\]", re.IGNORECASE)
#: What a text with any proposal has.
SOME = r"[0-9@]|\([aA][tT]\)|\[[aA][tT]\]"
MAYBE = re.compile(SOME)

LOOSE_EMAIL = re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{1,63}){1,6}", re.IGNORECASE)
LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:[ ()./_-]{0,3}[0-9]|[OI](?=[OI]?[ ()./_-]{0,3}[0-9])){5,24}")
LOOSE_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,5}(?: ?(?:[.,]|\[\.\]|\(\.\)) ?[0-9]{1,5}){3}(?![0-9])")
CUES = ("tel", "phone", "call", "fax", "mail", "contact", "card", "visa", "pay", "ip", "host", "server", "addr")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ outwards, so that long words stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _read(text: str) -> str:
    """Digits, with O read as 0 and I as 1."""
    return _digits(text.replace("O", "0").replace("I", "1"))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns that pass their tests, by start, then kind."""
    out = [Span(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [Span(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        out += [Span(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[Span]:
    """Spans of the generators; kinds and spans may overlap."""
    out = {Span(m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text)} if "@" in text or SPELLED.search(text) else set()
    out |= {Span(m.start(), 1, m.end()) for m in LOOSE_DOTTED.finditer(text)}
    for m in LOOSE_NUMBER.finditer(text):
        n = len(_read(m[0]))
        out |= {Span(m.start(), k, m.end()) for k, least, most in ((2, 12, 19), (3, 7, 15)) if least <= n <= most}
    return sorted(out)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    start, kind, end = span
    body = text[start:end]
    digits = _read(body)
    groups = re.findall("[0-9]+", body)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    words = before.lower()
    sizes = [len(g) for g in groups] or [0]
    kinds = [0.0] * len(KINDS)
    kinds[kind] = 1.0
    cue = [float(any(c in words for c in part)) for part in (CUES[:4], CUES[4:6], CUES[6:9], CUES[9:])]
    spelled = body.lower()
    return [
        *kinds, *cue, len(body), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(digits)),
        body.count(" "), body.count("-"), body.count("."), body.count("("), body.count("@"), sum(c.isalpha() for c in body),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("", " ", "\n")), float(after[:1] in ("", " ", "\n", ".", ",")),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(len(groups) == 4 and all(int(g) <= 255 for g in groups)), float(digits[:1] == "0"), float(digits[:2] == "00"),
        float("(at)" in spelled or "[at]" in spelled), float("(dot)" in spelled or "[dot]" in spelled), float(" @ " in body), float(". " in body), float(bool(re.search(r"[/_,\[]", body))),
    ]


# --- what the trees learn from ---------------------------------------------------


def variant(kind: int, body: str, rng: Random) -> str:
    """A base span in a form that the patterns do not take, or not whole."""
    if kind == 0:
        local, domain = body.rsplit("@", 1)
        at = rng.choice([" (at) ", "(at)", " [at] ", "[at]", " @ "])
        return local + at + domain.replace(".", rng.choice([".", "(dot)", " (dot) ", "[dot]", " [dot] "]))
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", ",", ". "]).join(body.split("."))
    digits = _digits(body)
    if kind == 2:
        mark = rng.choice([".", "/", "  ", " - ", "_"])
        out = mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        if rng.random() < 0.3:  # as optical readers err
            inner = [i for i, c in enumerate(out) if c in "01" and 0 < i < len(out) - 1 and out[i - 1].isdigit() and out[i + 1].isdigit()]
            if inner:
                i = rng.choice(inner)
                out = out[:i] + ("O" if out[i] == "0" else "I") + out[i + 1 :]
        return out
    mark = rng.choice([".", "/", " ", "-"])
    area, rest = digits[-10:-7], digits[-7:-4] + mark + digits[-4:]
    return rng.choice(["00" + body[1:], body[1:], f"({area}) {rest}", f"{area}{mark}{rest}", f"00{digits[:-10]}{mark}{area}{mark}{rest}"])


def lookalike(kind: int, body: str, rng: Random) -> str:
    """What is written like a variant of the kind and is none."""
    if kind == 0:
        local, domain = body.rsplit("@", 1)
        return f"{local} @ {domain.split('.')[0]}. {domain.split('.')[-1].capitalize()}"
    if kind == 1:
        parts = body.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return rng.choice(["[.]", "(.)", " . ", ",", ". ", "."]).join(parts)
    if kind == 2:
        digits = _digits(body)
        i = rng.randrange(len(digits))
        wrong = digits[:i] + str((int(digits[i]) + rng.randrange(1, 10)) % 10) + digits[i + 1 :]
        wrong = wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
        mark = rng.choice([".", "/", "  ", " - ", "_", "", " ", "-"])
        return mark.join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
    n = lambda low, high: str(rng.randrange(low, high))
    return rng.choice(
        [
            f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)} {n(10, 24)}.{n(10, 60)}", f"{n(10, 29)}/{n(10, 13)}/{n(1900, 2100)}", f"{n(1, 99)}.{n(100, 999)}.{n(100, 999)}.{n(100, 999)}",
            "-".join(n(10, 99) for _ in range(rng.randrange(4, 8))), n(10**6, 10**12), " ".join(n(1, 999) for _ in range(rng.randrange(4, 7))),
        ]
    )


def examples(text: str, seed: str) -> Iterator[tuple[int, float, list[float]]]:
    """(kind, accepted, features) of all proposals of a text: where its base spans are rewritten, and elsewhere."""
    base = base_spans(text)
    for s in base:
        rng = Random(f"{seed}:{s.start}:{s.kind}")
        low = max(0, s.start - AROUND)
        for make in (variant, lookalike):
            new = make(s.kind, text[s.start : s.end], rng)
            near = text[low : s.start] + new + text[s.end : s.end + AROUND]
            own = Span(s.start - low, s.kind, s.start - low + len(new))
            already = base_spans(near)
            for p in proposals(near):
                if p.start < own.end and own.start < p.end and p not in already:
                    yield p.kind, float(make is variant and p == own), features(near, p)
    taken = Taken(base)
    for p in proposals(text):
        if not taken.meets(p):
            yield p.kind, 0.0, features(text, p)


# --- the trees ---------------------------------------------------------------


class Trees(NamedTuple):
    """Boosted trees as arrays (children of leaves point to themselves) and a threshold for each kind."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    weights: list[float]
    least: list[float]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(rows), root)
            for _ in range(DEPTH):
                low = rows[np.arange(len(rows)), self.feature[at]] <= self.split[at]
                at = np.where(low, self.left[at], self.right[at])
            total += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * total))


def _exported(model) -> tuple:
    """The nodes of an MLlib boosted-trees model as arrays."""
    feature, split, left, right, value = [], [], [], [], []

    def visit(node) -> int:
        at = len(feature)
        for x in (feature, split, left, right, value):
            x.append(0)
        value[at], left[at], right[at] = node.prediction(), at, at
        if node.getClass().getSimpleName() == "InternalNode":
            feature[at], split[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = visit(node.leftChild()), visit(node.rightChild())
        return at

    roots = [visit(t._call_java("rootNode")) for t in model.trees]
    return np.array(feature), np.array(split, float), np.array(left), np.array(right), np.array(value, float), roots, list(model.treeWeights)


def threshold(accepted: np.ndarray, others: np.ndarray) -> float:
    """Least score from which held-out proposals (counts by bin of the score) are accepted at PRECISION; 2, none, if they nowhere are."""
    good, all_ = accepted[::-1].cumsum(), (accepted + others)[::-1].cumsum()
    fit = np.flatnonzero((good >= PRECISION * (all_ + 1)) & (all_ > 0))
    return max(FLOOR, (BINS - 1 - int(fit[-1])) / BINS) if len(fit) else 2.0


def _held(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("-")).cast("binary")) % HOLD_OUT == 0


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Trees | None:
    """Fit the trees on examples of at most `sample` documents, and calibrate on all held-out ones; None where the examples show one class only.

    Null ids and null texts teach nothing; repeated rows count as often as they come; an empty
    table gives None. Texts are read whole, however long; only doc_id and text are read.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(SOME))
    ids = some.where(~_held(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample).distinct()
    chosen = some.join(F.broadcast(save(ids)), "doc_id", "left_semi")  # `sample` ids at most
    rows = chosen.mapInArrow(tidy(_examples), "label double, x array<double>")
    fit = save(rows.orderBy(F.xxhash64("x"), "label").limit(SAMPLE_EXAMPLES))
    if fit.select("label").distinct().count() < 2:
        return None
    fit = fit.select("label", array_to_vector("x").alias("features")).coalesce(1)  # a bounded sample
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=LEARNING_RATE, seed=7, maxBins=64).fit(fit)
    trees = Trees(*_exported(model), [2.0] * len(KINDS))
    seen = some.where(_held(F.col("doc_id"))).mapInArrow(tidy(_scored(trees)), "kind int, bin int, good long, bad long")
    counts = np.zeros((2, len(KINDS), BINS))
    for r in seen.groupBy("kind", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():  # kinds times bins at most
        counts[:, r["kind"], r["bin"]] = r["good"], r["bad"]
    return trees._replace(least=[threshold(*counts[:, k]) for k in range(len(KINDS))])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(label, x) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, label, x in examples(text, str(key))]
        if out:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True))], names=["label", "x"])


def _scored(trees: Trees):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(KINDS), BINS), np.int64)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(examples(text, str(key)))
                if found:
                    kind, label, x = zip(*found, strict=True)
                    bins = np.minimum(trees.score(np.array(x)) * BINS, BINS - 1).astype(int)
                    np.add.at(counts, (1 - np.array(label, int), np.array(kind), bins), 1)
        kind, bins = np.nonzero(counts.sum(0))
        if len(kind):
            columns = [kind.astype(np.int32), bins.astype(np.int32), *counts[:, kind, bins]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["kind", "bin", "good", "bad"])

    return score


class Taken:
    """Spans that others must not overlap: the given ones, which may overlap each other, and added ones, which do not."""

    def __init__(self, spans: list[Span]) -> None:
        ordered = sorted((s.start, s.end) for s in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))
        self.added: list[tuple[int, int]] = []

    def meets(self, s: Span) -> bool:
        i = bisect.bisect_left(self.starts, s.end)  # those that begin before s ends; the furthest end of these
        if i and self.ends[i - 1] > s.start:
            return True
        i = bisect.bisect_left(self.added, (s.end, -1))
        return i > 0 and self.added[i - 1][1] > s.start

    def add(self, s: Span) -> None:
        bisect.insort(self.added, (s.start, s.end))


def added_spans(text: str, base: list[Span], trees: Trees | None) -> list[Span]:
    """Proposals that reach their kind's threshold, best first (then by place), without those that overlap what is already taken."""
    if trees is None or min(trees.least) > 1:
        return []
    taken, out = Taken(base), []
    found = [s for s in proposals(text) if trees.least[s.kind] <= 1 and not taken.meets(s)]
    if not found:
        return []
    scores = trees.score(np.array([features(text, s) for s in found]))
    for _, s in sorted((-p, s) for p, s in zip(scores.tolist(), found, strict=True) if p >= trees.least[s.kind]):
        if not taken.meets(s):
            out.append(s)
            taken.add(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


def find(df: DataFrame, keys: list[str], trees: Trees | None, redacted: bool = False) -> DataFrame:
    """For each row its `keys`, the counts n_email, n_ip, n_card, n_phone of base spans, base and spans (texts), and with `redacted` the text with all spans as [KIND].

    Null text counts as empty (and stays null when redacted). Where spans overlap, the text of
    all of them goes and the first names the kind. Rows are independent, so repeated ones get equal
    answers: no shuffle, memory for one whole text beyond the Arrow batch. Only `keys` and the text
    are read, whatever the names of other columns; an empty table gives no rows.
    """
    text_name = "text"
    while text_name in keys:
        text_name += "_"
    extra = [*(f"n_{k}" for k in KINDS), "base", "spans", *(["redacted"] if redacted else [])]
    types = [*(f"n_{k} long" for k in KINDS), "base string", "spans string", *(["redacted string"] if redacted else [])]

    def one(text: str | None) -> tuple:
        if not text or not MAYBE.search(text):
            return 0, 0, 0, 0, "", "", text
        base = base_spans(text)
        spans = [*base, *added_spans(text, base, trees)]
        counts = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
        return *counts, written(base), written(spans), cleaned(text, spans) if redacted else None

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t) for t in batch.column(len(keys)).to_pylist()] or [(0,) * 7]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            made = [pa.array(c, k) for c, k in zip(columns[: len(extra)], kinds, strict=False)]
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *extra])

    return df.select(*keys, df["text"].alias(text_name)).mapInArrow(tidy(convert), fields(df, keys, ", ".join(types)))


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind].upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def cleaned(text: str, spans: list[Span]) -> str:
    """redact(), again for what the patterns find only now that a neighbour is gone."""
    text = redact(text, spans)
    while spans := base_spans(text):
        text = redact(text, spans)
    return text


def redacted(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of `docs` with personal data in text replaced, and n_chars, where there is one, counted anew. Null and empty texts, repeated rows and empty tables stay as they are."""
    others = docs.drop("text")
    found = find(docs.select(whole(others), "text"), ["row"], trees, redacted=True)
    columns = {c: F.col(f"row.`{c}`") for c in others.columns} | {"text": F.col("redacted")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("redacted").isNull(), columns["n_chars"]).otherwise(F.length("redacted")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))
