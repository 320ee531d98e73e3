"""Operators 6 and 10 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from waymark.llm import ngram_join, suffix_dedup
from waymark.llm.common import numbered


def brute_classes(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent, linked = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
                linked[i] += 1
                linked[j] += 1
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return sorted(((k, len(sets[i]), least[find(i)], linked[i]) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))] for _ in range(20)]
    out = []
    for i in range(n):
        body = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            p, r = rng.randrange(len(body)), rng.random()
            if r < 0.4:
                body[p] = rng.choice(words)
            elif r < 0.7:
                body = body[:p] + body[p + 1 :] or ["x"]
            else:
                body.insert(p, rng.choice(words))
        if rng.random() < 0.2:
            body += rng.choice(bases)
        out.append((i, "  ".join(x.upper() if rng.random() < 0.05 else x for x in body)))
    return out


@pytest.mark.parametrize(("seed", "tile"), [(1, 2048), (2, 7)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "LINK_TILE", tile)
    rows = near_copies(seed)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows)


def test_classes_of_odd_documents(spark):
    docs = edge.documents(spark, clashing=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in ngram_join.classes(docs).collect()), key=str) == brute_classes(rows)
    assert ngram_join.classes(edge.none(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = edge.documents(spark, clashing=True)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.select("row").distinct().collect()[0][0] == "kept"
    classes = {c for _, n, c, _ in brute_classes([(i, r["text"]) for i, r in enumerate(docs.collect())]) if n}
    assert kept.where(F.trim(F.translate("text", "\n\t", "  ")) != "").count() == len(classes)
    assert kept.where("doc_id in (100, 101, 102)").count() == 3


def test_a_line_in_every_document_stays_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 4)
    monkeypatch.setattr(ngram_join, "TILE", 7)
    line = "all rights of this line are kept by those who wrote it here"
    rows = [(i, f"{line} {t}") for i, t in near_copies(3, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.classes(docs).collect()), key=str) == brute_classes(rows)
    arrays = docs.select("text").mapInArrow(ngram_join._arrays, "set_key long, n long, hashes binary, bits binary")
    hot = ngram_join.hot_shingles(arrays, len(rows))
    shingles = ngram_join.shingle_sets(*ngram_join.utf8(pa.array([line])))[0]
    assert set(shingles.tolist()) <= set(hot.tolist())
    held = ngram_join.Postings(4, np.uint64)
    for i in range(1000):  # a task's part: one witness for all of its sets, or none if the shingles are known to be hot
        held.add(i, len(shingles), shingles)
    batch = held.rows(reduced=True).to_pydict()
    assert sum(len(h) // 8 for h in batch["hashes"]) == len(shingles)


def test_links_added_to_components_equal_those_of_all_links(spark):
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31), *((40, k) for k in range(41, 60))]
    more = [(3, 11), (21, 30), (5, 6), (6, 60), (41, 42), *((59, k) for k in range(70, 90))]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    added = ngram_join.joined_by(frame(more), ngram_join.components(frame(first)))
    at_once = ngram_join.components(frame(first + more))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, at_once.collect()))
    assert dict(map(tuple, added.collect()))[11] == 1


def test_sums_in_tiles_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 80, dtype=np.uint64))
    arrays = [np.sort(rng.choice(base, rng.integers(50, 80), replace=False)) for _ in range(60)] + [base[:3], base[:4]]
    docs, side = rng.integers(1, 5, 62), rng.integers(0, 2, 62)
    for own in (None, side):
        want = [sum(docs[j] for j in range(62) if j != i and (own is None or own[i] != own[j]) and ngram_join.links(arrays[i], arrays[j])) for i in range(62)]
        assert ngram_join.count_in_tile(arrays, docs, own).tolist() == want


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_kind_and_without_python(spark, kind):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("a", "q"), (None, None)]
    if kind == "long":
        rows = [(None if k is None else ord(k), t) for k, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    kept = sorted(ngram_join.one_of_each(docs).collect(), key=str)
    assert [(r["doc_id"] in ("a", ord("a")), r["text"]) for r in kept] == [(True, "one two three four five six"), (True, "q"), (False, None)]
    cut = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.dedup(docs, length=20, gram=8).collect()}
    first = "a" if kind == "string" else ord("a")
    assert cut[first, 27] == 0 and sum(cut.values()) == 54
    plan = numbered(docs, "n", "doc_id", ["text"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_join_tile_finds_a_link_for_each_pair_of_components():
    a = np.arange(100, dtype=np.uint64)
    arrays = [a, a[:80], a[:60], a + np.uint64(1000)]
    found = ngram_join.join_tile(arrays, np.arange(4), lambda x, others: np.ones(len(others), bool))
    assert sorted(map(sorted, found)) == [[0, 1], [1, 2]]


def brute_dedup(rows, length):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        body = (text or "").encode()
        gone = [False] * len(body)
        for i in range(len(body) - length + 1):
            window = body[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(body), sum(gone), runs, bytes(b for b, g in zip(body, gone, strict=True) if not g)))
    return sorted(out, key=str)


def passages(seed, n=200):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é") for _ in range(400)) for _ in range(6)]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(6)):
            s, a = rng.choice(base), rng.randrange(300)
            text += s[a : a + rng.randrange(10, 300)] if rng.random() < 0.6 else "".join(rng.choice("abcde é") for _ in range(rng.randrange(1, 90)))
        if rng.random() < 0.1:
            text = rng.choice(["a", "ab", "abc "]) * rng.randrange(1, 300)
        out.append((i * 7 % 211, text))
    return list(dict(out).items())


def collected(df):
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [32_768, 2])
def test_dedup_equals_brute_force(spark, hot):
    rows = passages(5)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot)
    assert collected(got) == brute_dedup(rows, 100)


def test_a_line_in_every_document_is_settled_by_the_sender(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(200)) + line + "".join(rng.choice("ijklmnop ") for _ in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "n long, t string").repartition(3)
    hot = suffix_dedup.hot_anchors(docs, 100, 32, 50)
    assert 0 < len(hot) < 40
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["n", "t"])
    found = np.concatenate([value for _, _, value, _, _ in suffix_dedup._gathered(iter([batch]), 100, 32)])
    assert max(Counter(found.tolist()).values()) >= 300
    sent = [r for b in suffix_dedup._send_anchors(4, 100, 32, hot)(iter([batch])) for r in b.to_pylist() if r["kind"] == suffix_dedup.MEET]
    met = Counter(np.frombuffer(b"".join(r["hash"] for r in sent), np.uint64).tolist())
    assert max(met.values()) <= 50  # what one group can get of an anchor
    want = brute_dedup(rows, 100)
    assert collected(suffix_dedup.dedup(docs, "n", "t", hot=50)) == want


def test_anchors_do_not_depend_on_what_else_a_step_holds():
    text = np.frombuffer(b"abcabcabd" * 40 + bytes(range(97, 123)) * 9, np.uint8)
    alone = suffix_dedup.anchors(text, np.array([0, len(text)]))
    more = np.concatenate([text, np.zeros(100_000, np.uint8)])
    both = suffix_dedup.anchors(more, np.array([0, len(text), len(more)]))
    assert all((a == b[both[0] == 0]).all() for a, b in zip(alone, both, strict=True))


def test_dedup_of_odd_documents(spark):
    docs = edge.documents(spark, clashing=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(suffix_dedup.dedup(docs)) == brute_dedup(rows, 100)
    assert suffix_dedup.dedup(edge.none(spark)).count() == 0


def test_boundaries_from_the_transform_equal_common_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))]
        pieces += pieces[:1]
        text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8) + np.uint8(1)
        closing = np.cumsum([len(p) + 1 for p in pieces]) - 1
        ends = closing[np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])]
        order = suffix_dedup.suffix_order(text, ends)
        suffixes = [(text[i : ends[i]].tobytes(), i) for i in order]
        assert suffixes == sorted(suffixes)
        length = rng.choice([2, 5, 9])
        found = suffix_dedup.parted(text, order, length)
        for j in range(1, len(order)):
            a, b = suffixes[j - 1][0], suffixes[j][0]
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert bool(found[j]) == (same < length)
