"""Operator 8, BPE encoding and decoding by traversal of a trie of the distinct words.

For byte-pair encoding by ranks, the encoding of a prefix of a word is that of a shorter prefix
and one more token: the one of all vocabulary entries which end the prefix whose pair with the
last token before it is itself encoded as that pair. So one state, the last token, belongs to
each node of a trie of the words, and a node's state follows from its ancestors'. The distinct
words of a batch are sorted, which is the trie in depth-first order: the walk keeps the states
along the path to the current word and enters only nodes that the word before did not share.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from waymark.llm.common import fields, tidy

#: Words whose encodings a Python worker keeps between batches; beyond it they are computed again.
KEPT_WORDS = 200_000
#: Pairs of tokens whose validity a worker keeps.
KEPT_PAIRS = 300_000
SUFFIX = "</w>"
#: Signs (as a class of a regular expression) of texts that are normalized and split here.
PLAIN = "\x00-\x1b\x20-\u024f\u2010-\u2027\u20ac"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Encoder:
    """Words and texts to ids and back for a tokenizers file of a BPE with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or spec["decoder"] is not None:
            raise ValueError("only a BPE with the suffix </w> and no decoder is supported")
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer: {steps}")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {v: k for k, v in [*self.vocab.items(), *self.special.items()]}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.split = self.plain_split(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # U+001C to U+001F are white space to Python only
        self.rare = re.compile(f"[^{PLAIN}]")
        self.library = Tokenizer.from_str(json.dumps({**spec, "model": {**model, "vocab": {}, "merges": []}, "added_tokens": []}))
        self.signs = byte_signs()
        self.byte = {s: b for b, s in enumerate(self.signs)}
        self.alike = str.maketrans({b: s for b, s in enumerate(self.signs)})  # latin-1 text of the bytes
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        whole = {s for a, b in self.rank for s in (a, b, a + b)} | {s for s in self.vocab if len(s.removesuffix(SUFFIX)) == 1}
        #: Entries that the merges reach; of others no encoding has any. Keyed by text, with or without suffix.
        self.entries = {s for s in whole if s in self.vocab and self.merged(self.symbols(s)) == [s]}
        #: What entries begin with, and, by such a beginning, the entries that end with it (filled as needed).
        self.heads = {s[:k] for s in (x.removesuffix(SUFFIX) for x in self.entries) for k in range(1, len(s) + 1)}
        self.tails: tuple[dict[str, tuple], dict[str, tuple]] = ({}, {})

    @staticmethod
    def plain_split(pattern: str) -> re.Pattern:
        """The splitting pattern for re, which is faster: its classes as lists of the signs that normal() makes of plain ones."""
        signs = {y for x in regex.findall(f"[{PLAIN}]", "".join(map(chr, range(0x2100)))) for y in x + Encoder.normal(x)}
        for name in ("\\s", "\\p{L}", "\\p{N}"):
            members = "".join(re.escape(x) for x in sorted(signs) if regex.match(name, x))
            pattern = pattern.replace(name, members)
        return re.compile(pattern)

    @staticmethod
    def symbols(token: str) -> list[str]:
        body = token.removesuffix(SUFFIX)
        out = list(body)
        if len(body) < len(token) and out:
            out[-1] += SUFFIX
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left; for single tokens and pairs of them."""
        parts = list(parts)
        while len(parts) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether the tokens a, b side by side are what their symbols encode to."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return known

    def candidates(self, tail: str, ending: bool) -> tuple[tuple[str, int], ...]:
        """Entries that end a prefix whose longest tail among the heads is `tail`, longest first, with their lengths."""
        known = self.tails[ending].get(tail)
        if known is None:
            parts = [(tail[k:] + SUFFIX * ending, len(tail) - k) for k in range(len(tail))]
            known = self.tails[ending][tail] = tuple(p for p in parts if p[0] in self.entries)
        return known

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in byte signs)."""
        return {word: [self.vocab[t] for t in tokens] for word, tokens in self.tokenized(words).items()}

    def tokenized(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of distinct words (in byte signs): depth-first over the trie that their sorted order is.

        path[k] is the state of the prefix of k signs: its last token, where that begins, and the
        longest tail of the prefix that begins an entry.
        """
        out: dict[str, list[str]] = {}
        path: list[tuple[str, int, str]] = [("", 0, "")]
        before, heads, fits, candidates, pairs, (inner, last) = "", self.heads, self.fits, self.candidates, self.pairs, self.tails
        for word in sorted(words):
            shared, n = 0, len(word)
            for a, b in zip(before, word[:-1], strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]  # states of the shared prefix stay
            tail = path[-1][2]
            for i in range(len(path), n + 1):
                tail += word[i - 1]
                while tail not in heads:
                    tail = tail[1:]
                found = (inner if i < n else last).get(tail)
                for token, length in candidates(tail, i == n) if found is None else found:
                    low = i - length
                    if low == 0:
                        break
                    pair = path[low][0], token
                    known = pairs.get(pair)
                    if fits(*pair) if known is None else known:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                if i < n:
                    path.append((token, low, tail))
            before = word
            tokens = [token]
            while low:
                token, low, _ = path[low]
                tokens.append(token)
            tokens.reverse()
            out[word] = tokens
        return out

    @staticmethod
    def normal(text: str) -> str:
        """NFC, lower case sign by sign. White space stays: it only separates words."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Words of a text, with the special tokens that it spells out in their places."""
        if "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        """Words of a text without special tokens. Unicode tables differ between libraries, so a text
        with signs beyond Latin letters and common marks is normalized and split by the tokenizers library."""
        if not self.rare.search(text):
            return self.split.findall(self.normal(text))
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, word)).decode() for word, _ in split]

    def learn(self, pieces: set[str]) -> None:
        """Make sure that kept has every piece."""
        new = [p for p in pieces if p not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            self.said.clear()
            new = list(pieces)
        signs = {p: (p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.alike)) for p in new if p not in self.special}
        coded, vocab = self.tokenized(list(set(signs.values()))), self.vocab
        for p in new:
            if p in self.special:
                self.kept[p], self.said[p] = array("I", [self.special[p]]).tobytes(), p
                continue
            tokens = coded[signs[p]]
            self.kept[p], self.said[p] = array("I", map(vocab.__getitem__, tokens)).tobytes(), " ".join(tokens)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids (little-endian, 32 bits) and what they decode to."""
        split = [self.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        ids, said = self.kept.__getitem__, self.said.__getitem__
        return [(b"".join(map(ids, pieces)), " ".join(map(said, pieces))) for pieces in split]

    def forget(self) -> None:
        """Drop the words and pairs kept so far; they are made again when they are met."""
        self.kept, self.said, self.pairs = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(df: DataFrame, path: str, keys: list[str], text: str = "text", batch_chars: int = 1 << 20, forget: bool = False) -> DataFrame:
    """For each row its `keys`, ids (binary, little-endian unsigned 32-bit) and decoded (string).

    `path`: the tokenizers file, at the same place on every worker. Null text counts as empty and
    gives no ids and an empty string. Rows are independent (no shuffle); a worker holds one run
    of texts of about `batch_chars` and a bounded cache, which with `forget` goes at the end of each
    task, where other jobs share the workers. Only `keys` and the text are read.
    """
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keys)).to_pylist()]
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and (high == low or chars + len(texts[high]) <= batch_chars):
                    chars += len(texts[high])
                    high += 1
                ids, decoded = zip(*own.encode(texts[low:high]), strict=True)
                columns = batch.slice(low, high - low).columns[: len(keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*keys, "ids", "decoded"])
                low = high
        if forget:
            own.forget()

    return df.select(*keys, df[text]).mapInArrow(tidy(convert), fields(df, keys, "ids binary, decoded string"))
