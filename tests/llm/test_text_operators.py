"""Operators 1, 3, 5, 7 and 8 against brute force, libraries and exact round trips."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import edge
from waymark.llm import bpe, lm_scoring, media, merkle, pii, queries

# --- 1: LM scoring


def brute_scores(rows, order, least, backoff):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    counts = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(map(len, docs))
    out = []
    for (key, _), d in zip(rows, docs, strict=True):
        score = backed = 0
        for i in range(len(d)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                gram = tuple(d[i - k + 1 : i + 1])
                if k == 1:
                    s = counts[gram] / total
                elif counts[gram] >= least:
                    s = counts[gram] / counts[gram[:-1]]
                else:
                    continue
                score += math.log(s * backoff ** (longest - k))
                backed += k < longest
                break
        out.append((key, len(d), backed, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "GRAM_GROUP", 2000)
    docs = edge.documents(spark, clashing=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm_scoring.score_documents(docs, order=order).withColumn("log_score", F.round("log_score", 6)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_scores(rows, order, 2, 0.4)


def test_the_query_of_order_3_equals_brute_force(spark, tmp_path):
    rows = [(1, "a b c a b c d"), (2, "a b c"), (3, "b c d a b"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op1_lm_scoring"](spark, str(tmp_path)).collect()]
    want = brute_scores(rows, 3, 2, 0.4)
    assert sorted(r[:3] for r in got) == [r[:3] for r in want] and [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in want], abs=1e-4)


def test_counts_pass_a_byte_whole():
    numbers = np.array([1, 254, 255, 256, 10**12, 1, 300])
    assert (lm_scoring.widened(*lm_scoring.narrow(numbers)) == numbers).all()


def test_scores_of_nothing(spark):
    assert lm_scoring.score_documents(edge.none(spark)).count() == 0


# --- 3: personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["1", "2", "25", "0", "9", ".", "@", "a", "b-", "+", " ", "-", "(", ")", "x.y", "@a.b", "1.2.3.4", "é", "4111 1111", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        assert [tuple(s) for s in pii.base_spans(text)] == brute_spans(text), text
    for text in ("1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1" * 20_000, "@" * 20_000):
        assert [tuple(s) for s in pii.base_spans(text)] is not None  # stays linear


def test_find_keeps_base_spans_and_redacts(spark):
    docs = edge.documents(spark, clashing=True)
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    found = pii.find(docs, ["doc_id"], None).collect()
    want = sorted((k, ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in brute_spans(t or ""))) for k, t in rows if k is not None)
    assert sorted({(r["doc_id"], r["base"]) for r in found if r["doc_id"] is not None}) == want
    assert all(r["base"] == r["spans"] for r in found)
    clean = pii.redacted(docs, None)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert not brute_spans(r["text"] or "") and r["redacted"] == "kept"
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert pii.find(edge.none(spark), ["doc_id"], None).count() == 0 and pii.learn(edge.none(spark)) is None


def planted(rng, n, first=0):
    """Texts with one base form each, and the forms that only a learned span can find, with their places."""
    words = lambda: " ".join(rng.choice(["river", "stone", "light", "and", "was", "green", "call", "mail"]) for _ in range(8))
    card = lambda: next(c for c in iter(lambda: str(rng.randrange(4 * 10**15, 5 * 10**15)), "") if pii.luhn(c))
    forms = [
        lambda: f"x{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card,
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
    ]
    rows, wanted = [], []
    for i in range(n):
        kind = i % 4
        body = forms[kind]()
        look, new = pii.lookalike(kind, forms[kind](), rng), pii.variant(kind, body, rng)
        rows.append((first + i, f"{words()} {body} {words()}"))
        head = words() + " "
        wanted.append((first + i, f"{head}{new} {words()}", f"{words()} {look} {words()}", f"{pii.KINDS[kind]}:{len(head)}:{len(head) + len(new)}"))
    return rows, wanted


def brute_added(text, trees):
    """All proposals against the thresholds, each compared with all that were taken."""
    taken = [(a, b) for a, _, b in brute_spans(text)]
    found = [(-trees.score(np.array([pii.features(text, s)]))[0], s) for s in pii.proposals(text)]
    out = []
    for p, s in sorted(found):
        if -p >= trees.least[s.kind] and not any(a < s.end and s.start < b for a, b in taken):
            out.append(tuple(s))
            taken.append((s.start, s.end))
    return out


def test_learned_spans_join_what_the_patterns_miss(spark):
    rng = random.Random(4)
    rows, _ = planted(rng, 1600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    trees = pii.learn(docs)
    assert all(t <= 1 for t in trees.least)
    _, wanted = planted(rng, 400, 10_000)
    asked = spark.createDataFrame([(k, t) for k, t, _, _ in wanted] + [(-k, t) for k, _, t, _ in wanted], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(asked, ["doc_id"], trees).collect()}
    caught = np.mean([w in got[k] for k, _, _, w in wanted])
    wrong = np.mean([got[-k] != [""] for k, _, _, _ in wanted])
    assert caught > 0.85 and wrong < 0.1, (caught, wrong)
    texts = [t for _, t, _, _ in wanted[:60]] + [" ".join(t for _, t, _, _ in wanted[i : i + 20]) for i in range(60, 200, 20)]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(found, ["doc_id"], trees).collect():
        want = sorted(brute_spans(texts[r["doc_id"]]) + brute_added(texts[r["doc_id"]], trees))
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
    untouched = [t for _, t in rows[:50]]
    assert all(pii.added_spans(t, pii.base_spans(t), trees) == [] for t in untouched)


def test_a_proposal_within_a_long_base_span_is_not_added():
    text = "1.1.1.1.2.2.2.2.3.3.3.3.4.4.4.4.5.5.5.5.6.6.6.6.555.123.4567@a.example.com"
    base = pii.base_spans(text)
    everything = pii.Trees(np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.ones(1), [0], [9.0], [0.0] * 4)
    assert len(base) > 6 and pii.added_spans(text, base, everything) == []


def test_find_takes_columns_of_any_name(spark):
    docs = edge.documents(spark).selectExpr("doc_id", "text", "'kept' as text_", "'kept' as __text")
    got = pii.find(docs, ["doc_id", "text", "text_", "__text"], None)
    assert got.count() == docs.count() and got.select("__text").distinct().first()[0] == "kept"


# --- 5: media


def test_png_round_trip_and_checks():
    for text in (b"", b"x", b"ab" * 5000, bytes(range(256)) * 9, "é中".encode() * 700):
        payload = media.payload_of(text)
        data = media.encode_png(payload)
        assert len(payload) % 576 == 0 and len(payload) > 0 and media.decode_png(data).tobytes() == payload
        for i in (9, 20, 45, len(data) - 3):
            with pytest.raises(ValueError):
                media.decode_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def test_unfilter_undoes_all_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 12), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    rows = np.zeros((40, 13), np.uint8)
    for y in range(40):
        rows[y, 0] = kinds[y]
        for x in range(12):
            left = int(image[y, x - 1]) if x else 0
            up = int(image[y - 1, x]) if y else 0
            corner = int(image[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            rows[y, x + 1] = (int(image[y, x]) - [0, left, up, (left + up) // 2, near][kinds[y]]) % 256
    assert (media.unfilter(rows) == image).all()


def plain_png(data):
    """Samples of an 8-bit grey PNG, byte by byte as the format tells, without the operator's reader."""
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, own = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height = int.from_bytes(own[:4], "big"), int.from_bytes(own[4:8], "big")
            assert own[8:] == bytes([8, 0, 0, 0, 0])
        body += own if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(body), []
    for y in range(height):
        kind, line, row = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], []
        for x, value in enumerate(line):
            guess = {0: 0, 1: row[x - 1] if x else 0, 2: rows[y - 1][x] if y else 0}[kind]
            row.append((value + guess) & 255)
        rows.append(row)
    return rows


def plain_terms(rows):
    """The 64 low-frequency cosine terms of the image scaled to 32 by 32, each as its sum."""
    wide = len(rows[0]) // 32
    across = [[sum(row[x * wide : (x + 1) * wide]) / wide for x in range(32)] for row in rows]
    n = len(across)
    if n >= 32:
        bands = [across[y * n // 32 : (y + 1) * n // 32] for y in range(32)]
        small = [[sum(row[x] for row in band) / len(band) for x in range(32)] for band in bands]
    else:
        small = [across[y * n // 32] for y in range(32)]
    wave = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    return [math.fsum(small[y][x] * wave[k][y] * wave[j][x] for y in range(32) for x in range(32)) for k in range(8) for j in range(8)]


@pytest.mark.parametrize("size", [0, 1, 575, 5_000, 18_431, 40_000])
def test_media_and_feature_equal_a_plain_decoder_and_direct_sums(size):
    text = "".join(random.Random(size).choice(["the ", "river ", "é", "\n", "0 1 2 ", "stone."]) for _ in range(size // 3)).encode()[:size]
    _, data, n, digest, _, feature = media.one(text)
    rows = plain_png(data)
    back = b"".join(map(bytes, rows))
    assert back == text + b"\xff" * (-len(text) % 576 if text else 576) and (n, digest) == (len(back), hashlib.sha256(back).hexdigest())
    terms = plain_terms(rows)
    middle = sorted(terms[1:])[31]
    bits = [byte >> (7 - i) & 1 for byte in feature for i in range(8)]
    for term, bit in zip(terms, bits, strict=True):
        assert bit == (term > middle) or abs(term - middle) < 1e-5  # rounded to 6 digits there


def test_features_of_near_texts_are_near():
    rng = random.Random(8)
    words = [rng.choice(["light ", "GREEN ", "stone ", "7 ", "river\n"]) for _ in range(4000)]
    other = [rng.choice(["~~~ ", "zzzz ", "{} ", "yy "]) for _ in range(4000)]
    edit = [*words[:2000], "a few ", "words ", *words[2003:]]
    of = lambda w: int.from_bytes(media.one("".join(w).encode())[5], "big")
    assert (of(words) ^ of(edit)).bit_count() < (of(words) ^ of(other)).bit_count()


def test_media_columns_of_odd_documents(spark):
    docs = edge.documents(spark, clashing=True)
    got = media.media_columns(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    seen = {}
    for r in got:
        body = (r["text"] or "").encode()
        payload = body + b"\xff" * (-len(body) % 576 if body else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and struct.unpack(">I", bytes(r["media"])[16:20])[0] == 576
        assert seen.setdefault(payload, (bytes(r["media"]), bytes(r["cosine_hash"]))) == (bytes(r["media"]), bytes(r["cosine_hash"]))
    assert media.media_columns(edge.none(spark), ["doc_id"]).count() == 0


# --- 7: Merkle trees


def brute_pieces(text):
    """The rule sign by sign, without a pattern."""
    parts = lambda c: c != "\n" and (c < "\x0a" or "\x0b" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "\x7f" or "\u3000" <= c <= "\u3002" or "\uff01" <= c <= "\uff1f")
    out, start = [], 0
    for i, c in enumerate(text):
        if i < start:
            continue
        n = i - start + 1
        ends = c == "\n" or (n >= 2 and (text[i - 1] in "y0.,;:!?" or text[i - 1] >= "\x80") and parts(c))
        if (ends and n - (1 if c == "\n" else 2) <= 62) or n == 64:
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]] if start < len(text) else out


def brute_tree(text):
    leaves = [hashlib.md5(p.encode()).hexdigest() for p in brute_pieces(text)]
    parts, own = [], []
    for i, leaf in enumerate(leaves):
        own.append(leaf)
        if leaf.startswith("0") or i == len(leaves) - 1:
            body = ",".join(own)
            parts.append((hashlib.md5(body.encode()).hexdigest(), body))
            own = []
    return "|".join([hashlib.md5(",".join(n for n, _ in parts).encode()).hexdigest(), *(f"{n}:{b}" for n, b in parts)]), Counter(leaves)


def brute_fingerprint(text):
    whole = brute_tree(text)[0].split("|")
    names = [p[:32] for p in whole[1:]]
    while len(names) > 16:
        groups, own = [], []
        for i, n in enumerate(names):
            own.append(n)
            if n.startswith("0") or i == len(names) - 1:
                groups.append(hashlib.md5(",".join(own).encode()).hexdigest())
                own = []
        names = groups
    return whole[0] + ("|" + ",".join(n[:16] for n in names) if names else "")


def brute_near(a, b):
    (s, x), (t, y) = brute_tree(a), brute_tree(b)
    return 1.0 if s == t else 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


@pytest.mark.parametrize("block_bytes", [1 << 25, 500])
def test_fingerprints_equal_brute_force(spark, block_bytes):
    docs = edge.documents(spark, clashing=True)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows = [(k, t) for k, t, _ in sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))]
    want = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        want.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), brute_fingerprint(text), brute_fingerprint(new), brute_near(text, new), brute_near(text, following)))
    got = merkle.fingerprints(docs, block_bytes=block_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert all(merkle.consistent(merkle.written(merkle.leaves_of(t))) for _, t in rows)
    assert max(len(r["fingerprint"]) for r in got) <= 32 + 16 * 17
    assert merkle.fingerprints(edge.none(spark)).count() == 0


def test_pieces_are_the_text_whatever_it_holds():
    rng = random.Random(3)
    signs = ["a", "y", "0", ".", ",", " ", "\n", "é", "。", "中", "🙂", "-", "x" * 30, "\r", "\x85", "\u2028"]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 60)))
        assert "".join(merkle.pieces_of(text)) == text and merkle.pieces_of(text) == brute_pieces(text)
    assert merkle.fingerprint(merkle.written(merkle.leaves_of("key a"))) != merkle.fingerprint(merkle.written(merkle.leaves_of("key\na")))


def test_string_keys_and_a_lone_document(spark):
    r = merkle.fingerprints(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert r["near_next"] == 1 and merkle.fingerprints(spark.createDataFrame([(None, "x")], "doc_id long, text string")).count() == 1
    got = merkle.fingerprints(spark.createDataFrame([("b", "abcd"), ("a", "xy"), ("c", "q")], "doc_id string, text string"), block_bytes=1)
    edited = {r["doc_id"]: r["edited_sha256"] for r in got.collect()}
    assert edited == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in (("b", "abxy"), ("a", "xq"), ("c", "q"))}


@pytest.mark.parametrize("lines", [30, 200])
def test_differing_branches_locate_edits(lines):
    rng = random.Random(lines)
    text = ["".join(rng.choice("abcdefghi ") for _ in range(40)) for _ in range(lines)]
    tree = lambda x: merkle.written(merkle.leaves_of("\n".join(x)))
    whole, front = tree(text), tree(["one more line put in front", *text])
    assert merkle.differing(front, whole) == [(0, 0)] and merkle.differing(whole, front) == [] == merkle.differing(whole, whole)
    changed = tree([*text[:12], text[12] + " and more", *text[13:]])
    place = len(merkle.leaves_of("\n".join(text[:12]) + "\n"))
    flat = [(s, p) for s, (_, leaves) in enumerate(merkle.sections(changed)) for p in range(len(leaves))]
    assert merkle.differing(changed, whole) == [flat[place]]


def test_one_rule_for_all_lengths(spark):
    words = "the cat sat on my mat, and one more line of plain words came by then. " * 5
    for a, b in ((words[:256], words[:257]), (words[:260], words[:250])):
        assert merkle.likeness(merkle.leaves_of(a), merkle.leaves_of(b), False) > 0.8
    rows = spark.createDataFrame([(2, words[:300]), (1, "short text of fifty signs, or somewhat near to that")], "doc_id long, text string")
    assert 0.4 < merkle.fingerprints(rows).where("doc_id = 2").first()["near_edited"] < 0.8


@pytest.mark.parametrize("n", [40, 400])
def test_an_insertion_changes_only_the_leaves_it_touches(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) + rng.choice(["", "", ",", "."]) for _ in range(n)]
    changed = [w + "x" if i == 10 else w for i, w in enumerate(words)]
    a, b = (Counter(merkle.leaves_of(" ".join(w))) for w in (words, changed))
    assert 1 <= (a - b).total() <= 2 and 1 <= (b - a).total() <= 2


# --- 8: BPE

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoding_equals_the_library(spark):
    rng = random.Random(1)
    odd = ["I'll don't <|endoftext|> x", "Σας ΟΔΥΣΣΕΥΣ 中文字 İstanbul ǅ 🙂 é   a\x1cb\x85c​d ﬁ ½ ٣", "ab\x00cd\x7f", "x" * 500, "it's'S'T'RE", "<|startoftext|><|endoftext|>a"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x3000, 0xD7FF)])) for _ in range(40)) for _ in range(100)]
    docs = edge.documents(spark, clashing=True).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    for r in bpe.encode_decode(docs, PATH, ["doc_id", "text"]).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids, r["text"]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(edge.none(spark), PATH, ["doc_id"]).count() == 0


def test_trie_walk_equals_merging(monkeypatch):
    own = bpe.encoder(PATH)
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"a", "ab", "abc", "abcd"}
    for word, ids in own.words(list(words)).items():
        assert [own.tokens[i] for i in ids] == own.merged(own.symbols(word + bpe.SUFFIX))
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    fresh = bpe.Encoder(PATH)
    texts = ["one two three four five six", "seven one eight"]
    assert [a for a, _ in fresh.encode(texts)] == [a for a, _ in own.encode(texts)]
    assert own.decode(np.frombuffer(own.encode(texts)[0][0], "<u4").tolist()) == own.encode(texts)[0][1]


@pytest.mark.parametrize("control", ["\x1c", "\x1d", "\x1e", "\x1f"])
def test_separators_are_tokens_as_in_the_library(control):
    library = Tokenizer.from_file(PATH)
    for text in (f"ab{control}cd", f"{control}Ab {control} cd\n{control}"):
        ids, _ = bpe.encoder(PATH).encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_an_encoder_forgets_and_gives_the_same():
    """Workers that other stages of the pipeline share kept some hundred MB of words after the encoding stage."""
    own = bpe.encoder(PATH)
    first = own.encode(["some words, and a few more words"])
    assert own.kept
    own.forget()
    assert not own.kept and not own.pairs and own.encode(["some words, and a few more words"]) == first


def test_plain_texts_are_split_as_by_the_pattern_of_the_file():
    """op8_bpe: the pattern ran in a module that is slower than re, after white space had been replaced."""
    own = bpe.Encoder(PATH)
    with open(PATH, encoding="utf-8") as f:
        asked = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    assert isinstance(own.split, re.Pattern)
    signs = [chr(i) for i in range(0x2100) if not own.rare.search(chr(i))]
    for text in [*signs, "".join(signs), "".join(f"a{s}1" for s in signs), "x's it're \u0085 we'll\xa0d'd 12"]:
        normal = own.normal(text)
        assert own.plain(text) == asked.findall(re.sub(r"\s+", " ", normal)) == asked.findall(normal)
