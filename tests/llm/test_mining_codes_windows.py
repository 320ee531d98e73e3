"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from waymark.llm import decontaminate, phrases, vector_codes


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 11: phrases


def brute_phrases(rows, support, absorb=100, top=2000, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= absorb * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Éa", "ing", "that", "x" * 40, "中文", "it's", "no break", "A", "B"]
    common = ["of the A B c", "in order, to", "one two three four five six", "the the the the"]
    out = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40]))]
        out.append((["en", "de", None, "und"][i % 4], "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for p in parts)))
    return [*out, (None, None), ("en", ""), ("en", " .,\n "), ("fr", "word " * 5000), ("en", out[-1][1]), ("en", out[-1][1])]


@pytest.mark.parametrize(("support", "absorb", "top"), [(3, 100, 2000), (1, 100, 50), (10, 60, 7), (400, 100, 2000)])
def test_phrases_equal_brute_force(spark, support, absorb, top):
    rows = corpus(support)
    docs = spark.createDataFrame([(i, lang, t, 1, "kept") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, gram string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, support, absorb=absorb, top=top).collect())
    assert got == brute_phrases(rows, support, absorb, top)
    assert got or support == 400


def test_phrases_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(phrases, "small_enough", lambda *_: False)
    rows = corpus(7, 80)
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, 2).collect()) == brute_phrases(rows, 2)


def test_a_task_hands_counts_on_when_it_holds_too_many(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    rng = np.random.default_rng(2)
    held, buckets = phrases.Counts(), phrases.Buckets(100)
    want, want_buckets, got, found = Counter(), Counter(), Counter(), Counter()
    for _ in range(30):
        words = rng.integers(1, 60, 40).astype(np.uint64)
        grams = phrases.gram_hashes(words, 2)
        want.update(grams.astype(np.int64).tolist())
        want_buckets.update((grams & np.uint64((1 << phrases.BITS) - 1)).tolist())
        batches = [*held.add(phrases._counted(words, grams, np.arange(len(grams)), 2))]
        batches += [*buckets.add(grams)]
        for b in batches:
            tally(b, got, found)
    for b in [*held.rest(), *buckets.rest()]:
        tally(b, got, found)
    assert got == want and found == {k: v for k, v in want_buckets.items()}


def tally(batch, grams, buckets):
    for gram, n, g, places, counts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "n", "g", "places", "counts")), strict=True):
        if gram is not None:
            grams[gram] += n
        else:
            for place, times in zip(np.frombuffer(places, np.uint16).tolist(), np.frombuffer(counts, np.uint16).tolist(), strict=True):
                buckets[(g << phrases.LOW) + place] += times


def test_phrases_of_odd_documents_and_of_nothing(spark):
    docs = edge.documents(spark, clashing=True)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = phrases.collocations(docs, 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 4)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")}
    assert phrases.collocations(edge.none(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    """A product of a, n and 1000 of more than 2^63 is floored as whole numbers are."""
    big = spark.createDataFrame([(10**11 + 3, 10**13 + 1, 10**12 + 7, 10**11 + 9)], "a long, n long, l long, r long")
    whole = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    row = big.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (whole("a", 14) * whole("n", 18)), "below": whole("l", 14) * whole("r", 14)}).select(F.expr("above div below").alias("s")).first()
    assert row["s"] == 1000 * (10**11 + 3) * (10**13 + 1) // ((10**12 + 7) * (10**11 + 9))


def test_shares_of_a_language_give_the_same_ranks(spark):
    rng = random.Random(5)
    rows = [("en" if i % 3 else "de", f"p{i:03d}", rng.randrange(5), 1, 1, 9, rng.randrange(8)) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = {(r["lang"], r["rank"]): r["phrase"] for r in phrases.best_of(df, 10).collect()}
    for lang in ("en", "de"):
        want = sorted((-r[6], -r[2], r[1]) for r in rows if r[0] == lang)[:10]
        assert [got[lang, i + 1] for i in range(10)] == [w[2] for w in want]


# --- 12: codes of vectors


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label error) and the digest, in Python's whole numbers."""
    kept = [(i, [math.floor(float(np.float32(x)) * 256) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**18 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], None
    width = len(kept[0][1])
    cut = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cut]
    near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*own[e], strict=True)] if own[e] else old for e, old in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, v, lab in kept:
        met = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((i, "".join(f"{e:02x}" for _, e in met), sum(d for d, _ in met), lab))
        by_label[lab] += out[-1][2]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(seed, width, n):
    rng = random.Random(seed)
    rows = [(i * 7 % 1000, [rng.choice([rng.gauss(0, 1), rng.gauss(0, 40), 0.0, -0.5]) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(3, rows[0][1], 5), (3, rows[1][1], 5), (None, rows[2][1], None), (None, rows[2][1], None), rows[4], rows[4]]
    return rows + [(1, None, 0), (2, [], 0), (4, [None] * width, 1), (5, [float("nan")] * width, 1), (6, [math.inf] + [0.0] * (width - 1), 1), (8, [1e9] * width, 1), (9, [1.0] * (width + 1), 1), (10**6, [-1000.25] * width, 7)]


@pytest.mark.parametrize(("width", "n"), [(64, 150), (16, 100), (20, 90), (7, 80), (64, 20)])
def test_codes_equal_brute_force(spark, width, n):
    rows = vectors(width + n, width, n)
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, code int").repartition(3)
    got = vector_codes.compress(df).select("row.*", F.lower(F.hex("code")).alias("c"), "error", "label_error", "codebooks_sha256").collect()
    want, digest = brute_codes([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v, lab) for i, v, lab in rows])
    assert sorted(((r["vec_id"], r["c"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest} and {r["row"] for r in got} == {"kept"}


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("scale", [1, 50, 10**4, 2**26 - 1])
@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 16])
def test_bounds_never_lose_the_nearest_entry(scale, width):
    rng = np.random.default_rng(scale + width)
    book = rng.integers(-scale, scale + 1, (64, width))
    book[10:20] = book[0:10]  # ties
    rows = np.concatenate([rng.integers(-scale, scale + 1, (500, width)), book])
    entry, met, n_exact = vector_codes.nearest_entries(rows, book)
    all_distances = ((rows[:, None, :] - book) ** 2).sum(2)
    assert (entry == all_distances.argmin(1)).all() and (met == all_distances.min(1)).all()
    if width == 4 and scale > 1:
        assert n_exact < 0.75 * all_distances.size  # evenly spread numbers are the worst case for the bounds


def test_a_code_reads_back(spark):
    rows = [(i, [float(i % 8)] * 16, 0) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit(df)
    for r in vector_codes.encoded(df, books).collect():
        assert r["error"] == 0 and (vector_codes.decoded(r["code"], books) == 256 * (r["row"]["vec_id"] % 8)).all()


# --- 13: benchmark windows


def brute_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for i, text in items:
        words = split(text)
        for at in range(max(len(words) - 9, 1) if words else 0):
            windows[tuple(words[at : at + 10])].add(i)
    out = []
    for key, text in docs:
        words, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                if own := windows.get(tuple(words[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((key, len(words), len(hit), len(ids), ",".join(ids), bool(hit)))
    return sorted(out, key=str)


def benchmark(seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(30)] + ["the", "of", "Éa", "schön", "中文", "x1"]
    items = [(i, " ".join(rng.choice(base) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(30, items[5][1]), (31, items[5][1].upper()), (31, items[6][1]), (100, "the of"), (9, "of"), (None, "w1 w2 w3 w4 w5"), (40, None), (41, ""), (42, " -- !"), (43, items[7][1] + " and more of it")]
    docs = []
    for i in range(120):
        words = [rng.choice(base) for _ in range(rng.choice([0, 1, 5, 30, 200]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            part = (rng.choice(items)[1] or "").split()
            at, cut = rng.randrange(len(words) + 1), rng.randrange(len(part) + 1)
            words[at:at] = part if rng.random() < 0.6 else part[cut:]
        docs.append((i, rng.choice([" ", "-", ". ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs + [docs[3], docs[3], (3, docs[4][1]), (None, docs[5][1]), (None, None), (None, None), (7, None), (8, ""), (9, "w1 " * 20_000 + items[0][1])], items


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_brute_force(spark, monkeypatch, seed, wide):
    if wide:  # as if windows were too many to broadcast
        monkeypatch.setattr(decontaminate, "small_enough", lambda *_: False)
    docs, items = benchmark(seed)
    if seed == 2:  # one length of shingles only
        items = [x for x in items if len(re.findall(r"\w+", x[1] or "")) != 1 and len(re.findall(r"\w+", x[1] or "")) != 2]
    df = spark.createDataFrame([(*d, 1, "kept") for d in docs], "doc_id long, text string, n_words int, key string").repartition(3)
    bench = spark.createDataFrame([(*i, "kept") for i in items], "item_id long, text string, words string")
    got = decontaminate.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(docs, items)


def test_windows_of_odd_documents_and_of_nothing(spark):
    docs = edge.documents(spark, clashing=True)
    bench = spark.createDataFrame([(1, "that the of that"), (2, "Éa"), (3, "tie tie")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(rows, [(1, "that the of that"), (2, "Éa"), (3, "tie tie")])
    assert decontaminate.contamination(edge.none(spark), bench).count() == 0
    clean = decontaminate.contamination(docs, bench.where("false"))
    assert clean.count() == docs.count() and clean.where("contaminated OR n_hit > 0").count() == 0


def test_no_python_on_the_main_path(spark):
    docs, items = benchmark(1)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, _ = decontaminate.occurrences(df, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan) and plan.count("xxhash64") > 0
