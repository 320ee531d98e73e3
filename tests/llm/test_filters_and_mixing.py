"""Operators 2, 4 and 9, and the pipeline."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm import edge
from waymark.llm import mixing, oracles, pii, quality, queries, url_filter

DATA = "/root/testdata/sf0.001"

# --- 2: URL filters


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "://x", "http://COM/", "http://a.com", "http://a.com/x?y#z", "https://www.example.com/en/1", "http://m.www.example.com/en/1",
    "http://example.com/en/", "http://xexample.com/en/", "http://example.com/en", "http://a.NET/es/1", "http://net/fr/", "http://b.net/de/", "http://b.org/es/", "ftp://É.com/ö",
    "http://a.com?x=/en/", "http://a.com#f", "a://b://c.com/", "http://" + "x" * 5000 + ".org/",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "kept") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, slots string")
    got = url_filter.judge_urls(df).orderBy("page_id").collect()
    for r, (_, url, _) in zip(got, rows, strict=True):
        host, path, verdict, rule = brute_rule(url)
        assert (r["host"], r["path"], r["rule"], r["slots"]) == (host, path, rule, "kept")
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_model_tells_apart_what_it_has_seen(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(f"http://{word('abcd')}.com/", 1) for _ in range(150)] + [(f"http://{word('wxyz')}.net/es/", 0) for _ in range(150)]
    asked = [(f"http://{word('abcd')}.org/", "allow") for _ in range(40)] + [(f"http://{word('wxyz')}.org/", "block") for _ in range(40)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows + asked)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df).collect()}
    assert np.mean([got[300 + i] == v for i, (_, v) in enumerate(asked)]) > 0.9


# --- 4: mixing


def brute_fill(budget, nodes):
    """nodes: name -> (capacity, weight). Serves by rising capacity per weight."""
    out, left, weight = {}, budget, sum(w for _, w in nodes.values())
    order = sorted(nodes, key=lambda n: (nodes[n][0] * 1_000_000 // nodes[n][1], n))
    for i, name in enumerate(order):
        cap, w = nodes[name]
        if cap * weight <= left * w:
            out[name], left, weight = cap, left - cap, weight - w
        else:
            out |= {n: min(left * nodes[n][1] // weight, nodes[n][0]) for n in order[i:]}
            break
    return out


def test_budgets_equal_brute_force(spark):
    docs = edge.documents(spark)
    rows = mixing.mix(docs, share=0.7, epochs=2).collect()
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, mixing.DEFAULT_WEIGHT)
    size = Counter()
    for r in rows:
        size[r["m_domain"], r["lang"] or "-", "-" if r["source"] is None else r["source"]] += r["m_tokens"]
    caps = {k: 2 * v for k, v in size.items()}
    budgets = {(): min(math.floor(sum(size.values()) * 0.7), sum(caps.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, budget in budgets.items():
            below = defaultdict(int)
            for k, c in caps.items():
                if k[:depth] == parent:
                    below[k[depth]] += c
            new |= {(*parent, n): b for n, b in brute_fill(budget, {n: (c, weight(level, n)) for n, c in below.items()}).items()}
        budgets = new
    taken, largest = Counter(), Counter()
    for r in rows:
        leaf = (r["m_domain"], r["lang"] or "-", "-" if r["source"] is None else r["source"])
        taken[leaf] += r["m_tokens"] * r["m_copies"]
        largest[leaf] = max(largest[leaf], r["m_tokens"])
    for leaf, budget in budgets.items():
        assert budget <= taken[leaf] < budget + max(largest[leaf], 1) and max(r["m_copies"] for r in rows) <= 2


ODD_IDS = {
    "null ids": [(None, f"{i} two three") for i in range(100)],
    "null ids and one text": [(None, "one two three") for i in range(100)],
    "one id has most rows": [(7 if i < 60 else i, f"word {i} x") for i in range(100)],
    "most rows are the same": [(7, "a b c d") if i < 60 else (i, f"word {i} x") for i in range(100)],
    "null texts": [(i % 3, None) for i in range(50)],
}


@pytest.mark.parametrize("case", ODD_IDS)
def test_repeated_and_null_ids_keep_to_the_budget_and_equal_the_sql(spark, case):
    rows = [(i, t, "en", "src0", None) for i, t in ODD_IDS[case]]
    docs = spark.createDataFrame(rows, edge.COLUMNS).repartition(4)
    got = mixing.mix(docs).select("doc_id", F.col("m_domain").alias("domain"), "lang", "source", F.col("m_tokens").alias("n_tokens"), F.col("m_copies").alias("n_copies")).collect()
    budget = sum(r["n_tokens"] for r in got) // 2
    assert budget <= sum(r["n_tokens"] * r["n_copies"] for r in got) < budget + max(r["n_tokens"] for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(oracles.MIXING).fetchall()))
    assert sorted(map(str, [r["n_copies"] for r in got])) == sorted(map(str, brute_copies([r[:4] for r in rows])))
    again = mixing.taken(docs)
    assert again.count() == sum(r["n_copies"] for r in got)


def test_shortage_goes_to_siblings_first():
    filled = brute_fill(100, {"a": (10, 1), "b": (1000, 1), "c": (1000, 2)})
    assert filled == {"a": 10, "b": 30, "c": 60}


def test_budgets_beyond_doubles_are_exact(spark):
    leaves = [("d0", "en", "a", 3_000_000_000_000_001), ("d0", "de", "a", 7_000_000_000_000_003), ("d1", "en", "b", 900_000_000_000_007), ("d2", "x", "src0", 11)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["domain"] + r["lang"]: r["grant"] for r in mixing.leaf_budgets(df, 0.5, 1, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT).collect()}
    total = math.floor(float(sum(x[3] for x in leaves)) * 0.5)
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, mixing.DEFAULT_WEIGHT)
    top = brute_fill(total, {"d0": (10_000_000_000_000_004, 400_000), "d1": (900_000_000_000_007, 300_000), "d2": (11, 150_000)})
    below = brute_fill(top["d0"], {"en": (3_000_000_000_000_001, weight("lang", "en")), "de": (7_000_000_000_000_003, weight("lang", "de"))})
    assert got == {"d0en": below["en"], "d0de": below["de"], "d1en": top["d1"], "d2x": top["d2"]}


def test_taken_keeps_rows_whole(spark):
    docs = edge.documents(spark, clashing=True)
    mixed = mixing.mix(docs)
    got = mixing.taken(docs)
    assert got.columns == docs.columns and got.select("m_copies").distinct().first()[0] == "kept"
    assert got.count() == mixed.agg(F.sum("m_copies")).first()[0] and mixed.count() == docs.count()
    assert mixing.mix(edge.none(spark)).count() == 0 and mixing.taken(edge.none(spark)).count() == 0


def test_seed_changes_the_choice_only(spark):
    docs = edge.documents(spark)
    a, b = (mixing.mix(docs, share=0.4, seed=s).select("doc_id", "m_copies").collect() for s in ("x", "x"))
    assert sorted(map(str, a)) == sorted(map(str, b))


# --- 9: quality


def corpus(spark, n=400):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "light", "and", "was", "green"]) for _ in range(60)) + "."
    poor = lambda: " ".join(rng.choice(["BUY", "now", "###", "$$$", "click"]) for _ in range(60))
    rows = [(i, poor() if i % 5 == 0 else good()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, n, 3)], "doc_id long, quality int, toxic int")
    return docs, marks


def test_held_out_accuracy(spark):
    docs, marks = corpus(spark)
    got = quality.judged(docs, marks).collect()
    assert np.mean([r["q_kept"] == (r["doc_id"] % 5 > 0) for r in got if r["doc_id"] % 3]) > 0.97


M64 = (1 << 64) - 1


def brute_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def brute_buckets(text):
    """Buckets of a text's unigrams and bigrams, token by token."""
    kind = lambda b: 0 if b in (32, 9, 10, 11, 12, 13) else 1 if b >= 128 or chr(b).isalnum() else 2
    tokens, last = [], 0
    for b in text.encode():
        if kind(b) and kind(b) == last:
            tokens[-1].append(b)
        elif kind(b):
            tokens.append([b])
        last = kind(b)
    names = [brute_mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(t)) & M64) for t in tokens]
    second = (0x9E3779B97F4A7C15 * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D | 1) & M64
    pair = lambda a, b: 0x5EED if a == b else brute_mixed((0x51ED270B0129 * 2 + a * 0x9E3779B97F4A7C15 + b * second) & M64)
    return [x % quality.BUCKETS for x in [*names, *(pair(a, b) for a, b in zip(names, names[1:], strict=False))]]


def brute_quality(docs, labels, seed="quality-1"):
    """doc_id, log ratio, weight, kept of each (doc_id, text), from tables alone."""
    marks = {}
    for k, q, *_ in labels:
        if k is not None and q is not None:
            marks[k] = max(q, marks.get(k, q))
    held = {k for k in marks if zlib.crc32(str(k).encode()) % 4 == 0}
    grams = [brute_buckets(t or "") for _, t in docs]
    raw = Counter(b for g in grams for b in g)
    target = Counter(b for (k, _), g in zip(docs, grams, strict=True) for b in g if marks.get(k) == 1 and k not in held)
    log = lambda c, b: math.log((c[b] + 0.1) / (c.total() + 0.1 * 65536))
    sums = [sum(log(target, b) - log(raw, b) for b in g) if target else 0.0 for g in grams]
    fit = quality.fitted([(s, len(g), marks[k]) for (k, _), s, g in zip(docs, sums, grams, strict=True) if k in held])
    if fit is None:
        return [(k, round(s, 6), 0.0, True) for (k, _), s in zip(docs, sums, strict=True)]
    ratios = [s + fit.shift * len(g) for s, g in zip(sums, grams, strict=True)]
    k_ = round(sum(1 / (1 + math.exp(min(700, -(fit.slope * r + fit.intercept)))) for r in ratios))
    noise = lambda k: -math.log(-math.log((int(hashlib.md5(f"{seed}:{'-' if k is None else k}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48))
    weights = [fit.slope * r + noise(k) for (k, _), r in zip(docs, ratios, strict=True)]
    least = sorted(weights, reverse=True)[k_ - 1]
    return [(k, r, w, w >= least) for (k, _), r, w in zip(docs, ratios, weights, strict=True)]


def corpus_between(spark, n=300):
    """As corpus(), with texts that mix both kinds of words."""
    rng = random.Random(8)
    share = lambda i: (i * 37 % 101) / 100
    word = lambda p: rng.choice(["the", "of", "river", "stone", "light"]) if rng.random() < p else rng.choice(["BUY", "now", "###", "$$$"])
    rows = [(i, " ".join(word(share(i)) for _ in range(rng.randrange(3, 60)))) for i in range(n)] + [(None, "no id"), (n, None)]
    marks = [(i, int(share(i) + rng.gauss(0, 0.15) > 0.5), 0) for i in range(0, n, 2)]
    return rows, marks


def test_query_equals_brute_force(spark, tmp_path):
    rows, marks = corpus_between(spark)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in queries.QUERIES["op9_quality"](spark, str(tmp_path)).select("doc_id", "log_ratio", "q_weight", "kept").collect()), key=key)
    want = sorted(brute_quality(rows, marks), key=key)
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in want]
    assert np.allclose([r[1:3] for r in got], [r[1:3] for r in want], atol=1e-4)
    plain = sorted((r[1] for r in want), reverse=True)[sum(r[3] for r in want) - 1]
    assert any((r[1] >= plain) != r[3] for r in want)  # the noise has a say


def test_inclusion_follows_the_weights(spark):
    weights = [0.0, 0.5, 1.0, 2.0]
    rows = spark.range(16_000).select("id", (F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("draw"))
    log_weight = F.get(F.array(*map(F.lit, weights)), F.col("i").cast("int"))
    first = rows.groupBy("draw").agg(F.max_by("i", log_weight + quality.gumbel("s", F.col("id"))).alias("i")).groupBy("i").count().collect()
    got = np.array([n for _, n in sorted((r["i"], r["count"]) for r in first)]) / 4000
    assert np.allclose(got, np.exp(weights) / np.exp(weights).sum(), atol=0.03)


def test_log_ratios_equal_brute_force(spark):
    docs, marks = corpus(spark, 60)
    marked = docs.join(marks.select("doc_id", F.col("quality").alias("good")), "doc_id", "left")
    rows = marked.collect()
    raw = Counter(b for r in rows for b in brute_buckets(r["text"]))
    target = Counter(b for r in rows if r["good"] for b in brute_buckets(r["text"]))
    want = [math.log((target[b] + 0.1) / (target.total() + 6553.6)) - math.log((raw[b] + 0.1) / (raw.total() + 6553.6)) for b in range(65536)]
    assert np.allclose(quality.log_ratios(marked), want)


def test_what_does_not_tell_apart_keeps_all():
    assert quality.fitted([]) is None and quality.fitted([(1.0, 3, 1)] * 4) is None
    assert quality.fitted([(-5.0, 3, 1), (5.0, 3, 0)] * 20) is None


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 200])
def test_top_k_equals_sorting(spark, k):
    rng = random.Random(k)
    rows = [(i, round(rng.choice([rng.gauss(0, 1000), 1.5]), 6)) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, v double")
    got = {r["i"] for r in quality.top_k(df, "v", ["i"], k, "kept").where("kept").collect()}
    want = sorted(rows, key=lambda r: -r[1])[:k]
    assert len(got) == len(want) and sorted(rows[i][1] for i in got) == sorted(v for _, v in want)


def test_quality_of_odd_documents(spark):
    docs = edge.documents(spark, clashing=True)
    assert quality.judged(docs, edge.labels(spark)).count() == docs.count()
    kept = quality.keep_good(docs, edge.labels(spark))
    assert kept.columns == docs.columns and kept.count() <= docs.count() and kept.select("q_kept").distinct().first()[0] == "kept"
    assert quality.keep_good(docs, edge.labels(spark).where("false")).count() == docs.count()
    assert quality.judged(edge.none(spark), edge.labels(spark)).count() == 0


# --- whole tables and the pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toArrow()
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    columns = sorted(names)
    assert columns == sorted(got.column_names)
    ours = sorted(map(repr, zip(*(got[c].to_pylist() for c in columns), strict=True)))
    assert ours == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    word = lambda p: rng.choice(["the", "of", "river", "stone", "light", "call"]) if rng.random() < p else rng.choice(["BUY", "now", "###", "$$$"])
    more = [(200 + i, " ".join(word(0.1 if i % 4 == 0 else 0.9) for _ in range(rng.randrange(4, 60))), "en", f"src{i % 3}", 0) for i in range(120)]
    edge.documents(spark).union(spark.createDataFrame(more, edge.COLUMNS)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(200 + i, int(i % 4 > 0), 0) for i in range(120)]
    edge.labels(spark).where("doc_id < 10 or doc_id is null").union(spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    return folder


def brute_copies(rows):
    """How often the mixture takes each (doc_id, text, lang, source)."""
    weight = lambda level, name: {"domain": {"d0": 400_000, "d1": 300_000}, "lang": {"en": 500_000, "de": 250_000}, "source": {"src0": 200_000}}[level].get(name, 150_000)
    number = lambda source: re.search("([0-9]{1,9})$", source or "")
    leaf = [(f"d{int(number(s)[1]) % 4 if number(s) else 0}", lang or "-", "-" if s is None else s) for _, _, lang, s in rows]
    n = [max(len(re.split("[ \t\n\r]+", (t or "").strip(" "))), 1) for _, t, _, _ in rows]
    size = Counter()
    for k, x in zip(leaf, n, strict=True):
        size[k] += x
    budgets = {(): min(math.floor(sum(n) * 0.5), 4 * sum(n))}
    for depth, level in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, budget in budgets.items():
            below = Counter()
            for k, x in size.items():
                if k[:depth] == parent:
                    below[k[depth]] += 4 * x
            new |= {(*parent, name): b for name, b in brute_fill(budget, {name: (c, weight(level, name)) for name, c in below.items()}).items()}
        budgets = new
    text = [hashlib.md5((r[1] or "").encode()).hexdigest() for r in rows]
    key = [(hashlib.md5(f"mix-1:{budgets[k] // size[k]}:{'-' if r[0] is None else r[0]}:{t}".encode()).hexdigest(), i) for i, (r, k, t) in enumerate(zip(rows, leaf, text, strict=True))]
    out = []
    for i, k in enumerate(leaf):
        before = sum(n[j] for j in range(len(rows)) if leaf[j] == k and key[j] < key[i])
        out.append(budgets[k] // size[k] + (before < budgets[k] % size[k]))
    return out


def test_pipeline_equals_brute_force(spark, small):
    from tests.llm.test_join_and_dedup import brute_classes
    from tests.llm.test_text_operators import brute_added, brute_spans

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    marks = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    kept = [r for r, q in zip(rows, brute_quality([r[:2] for r in rows], marks), strict=True) if q[3]]
    assert len(kept) < len(rows)  # some go
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    unique = [order[i] for i, _, c, _ in brute_classes([(i, r[1]) for i, r in enumerate(order)]) if i == c]
    trees = pii.learn(spark.createDataFrame([(*r, None) for r in unique], docs.schema))

    def clean(text):
        if text is None:
            return None
        spans = sorted(brute_spans(text) + (brute_added(text, trees) if trees else []))
        while spans:
            out, at = "", 0
            for a, k, b in spans:
                out, at = (out + text[at:a] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]" if a >= at else out), max(at, b)
            text = out + text[at:]
            spans = brute_spans(text)
        return text

    cleaned = [(r[0], clean(r[1]), *r[2:]) for r in unique]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for r, copies in zip(cleaned, brute_copies(cleaned), strict=True):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want += [(r[0], r[2], r[3], len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(decoded.encode()).hexdigest())] * copies
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]


def test_every_stage_takes_clashing_names(spark, small):
    docs = edge.documents(spark, clashing=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() > 0 and (name == "encoding" or out.columns == docs.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    edge.none(spark).write.parquet(f"{tmp_path}/documents.parquet")
    edge.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
