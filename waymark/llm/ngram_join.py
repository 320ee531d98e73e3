"""Operator 6, n-gram Jaccard join: all documents whose shingle sets overlap by SHARE or more, exactly.

A set is a document's distinct five-word shingles (64-bit hashes). Documents with one and the
same set form a class; classes are joined, not documents.

1. Filter. In the order of hashes, two sets that link share at least l of their first
   n - ceil(SHARE n) + l shingles (l = n // 4 + 1). These prefixes are dealt by hash (32 bits;
   a false match only lets a set pass), and sets with too few shingles that any other prefix
   holds can link with nothing. What follows sees the others only, with all their shingles.
2. Prefix. Ordered by how many sets hold it, a set's rarest n - ceil(SHARE n) + 1 shingles must
   hold one that a partner's hold; shingles of one set only count towards them and are not kept.
3. Leaders. Among the sets that hold such a shingle (in blocks of TILE) each meets the first leader
   that the bound below lets it link with, or becomes a leader; what meets is verified. A second
   round does so with one set of each component. That joins groups of near copies by stars,
   without all their pairs.
4. Tiles. Sets that share a rare shingle and are still apart go, under the least of them, to tiles
   by band of size; a tile holds one band and the one below, since sets that link are in one or in
   neighbouring bands. More than TILE sets are cut into blocks: sets of the largest component
   meet only the others. Hashed bitmap signatures, wide for the sets of the tile, bound overlaps
   from above: each bit that only one of two sets has is a shingle that they don't share. What
   passes is verified by intersecting the sorted arrays, and a link is kept if its sets were not
   yet joined.
   So no link between components is lost, and no group is expanded into all its pairs.
5. Links. Every link lies within a component. The sets of each component (in size-banded tiles of
   blocks, where there are more than LINK_TILE) meet once more under the same bound and the exact test,
   and each set adds up the documents of the sets that it links with; only these sums leave a tile.

A shingle that very many sets hold meets no more than a task's own part of them: what a task has
seen in two sets is shared for certain, so one witness goes on for all; and shingles in more than
one of HOT_SHARE sets are told to the tasks beforehand and stand last in the order of rarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import gram_hashes, groups_for, join_checked, join_skewed, mixed, numbered, save, steps, tidy, utf8, whole, word_hashes

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Bits of a signature, and the ratio of neighbouring bands' sizes.
BITS, BAND = 512, 0.75
#: Sets of one tile beyond which it is cut into blocks, and rounds of leaders.
TILE, ROUNDS = 2048, 2
#: Sets of a block when links are counted: smaller, since every component has to be met whole.
LINK_TILE = 512
#: Shingles of a group of the first filter and of the later ones; rows that a task gathers before it sends them on.
FILTER_GROUP, SHINGLE_GROUP, SET_GROUP, LEADER_GROUP, GATHER = 1_000_000, 500_000, 20_000, 30_000, 1 << 19
#: A shingle in more than one of so many sets is hot; there are at most so many times the mean number of a set's shingles.
HOT_SHARE = 100
#: Rarity of hot shingles, beyond that of all others; and who stands for a witness (a task sends fewer sets at once).
HOT, WITNESS = 1 << 50, 65_535

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """For each row its distinct shingles' hashes, ascending; fewer than n words are one shingle, none are none."""
    words, first = word_hashes(data, offsets)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def set_key(hashes: np.ndarray) -> int:
    """64 bits that name a set."""
    total = mixed(hashes ^ _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + _U(len(hashes))
    return int(mixed(np.array([total]))[0])


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(SHARE n): what a set of n shingles shares at least with one that it links with."""
    return -(-n * NUMERATOR // DENOMINATOR)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or least_overlap(len(b)) > len(a):
        return False
    place = np.searchsorted(b, a)
    both = int((b[np.minimum(place, len(b) - 1)] == a).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def signature(hashes: np.ndarray) -> np.ndarray:
    """A bit for each value of hash modulo BITS, as bytes."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes % _U(BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def may_link(bits: np.ndarray, n: np.ndarray, other_bits: np.ndarray, other_n: int) -> np.ndarray:
    """Whether the bound from sizes and signatures lets each of many sets link with another one."""
    only = np.bitwise_count(bits & ~other_bits).sum(1, dtype=np.int64)
    other_only = np.bitwise_count(~bits & other_bits).sum(1, dtype=np.int64)
    most = np.minimum(n - only, other_n - other_only)
    return DENOMINATOR * most >= NUMERATOR * (n + other_n - most)


# --- steps 1 and 2 -----------------------------------------------------------------


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys = [], []
        for _, _, data, offsets in steps(*utf8(batch.column(1))):
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else 0)
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "text_key", "n", "set_key"])


POSTINGS = "g long, hashes binary, who binary, keys binary, sizes binary"


class Postings:
    """Shingles of many sets, sent on as one row for each group of hashes: hashes, whose, and the sets' names and sizes."""

    def __init__(self, groups: int, kind: type) -> None:
        self.groups, self.kind = groups, kind
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.keys: list[int] = []
        self.sizes: list[int] = []
        self.held: set[int] = set()
        self.count = 0

    def add(self, key: int, size: int, hashes: np.ndarray) -> bool:
        """Whether it is time to send."""
        if key not in self.held:
            self.held.add(key)
            self.hashes.append(hashes)
            self.keys.append(key)
            self.sizes.append(size)
            self.count += len(hashes)
        return self.count >= GATHER or len(self.keys) >= 60_000

    def rows(self, reduced: bool = False, hot: np.ndarray | None = None) -> pa.RecordBatch:
        """`reduced`: of hashes that two sets or more hold here only a witness goes on, and each set's number of them.

        `hot`: hashes that go on with their sets alone. Both kinds of sure knowledge have no `who`.
        """
        hashes = np.concatenate(self.hashes)
        who = np.repeat(np.arange(len(self.keys), dtype=np.uint16), [len(h) for h in self.hashes])
        sure: list[tuple] = []
        if reduced:
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            same = ordered[1:] == ordered[:-1]
            both = np.zeros(len(hashes), bool)
            both[order] = np.append(False, same) | np.append(same, False)
            times = np.bincount(who[both], minlength=len(self.keys))
            own = np.flatnonzero(times)
            witnesses = np.unique(hashes[both])
            hashes = np.append(hashes[~both], witnesses)
            who = np.append(who[~both], np.full(len(witnesses), WITNESS, np.uint16))
            sure = [(self.keys[own[0]] % self.groups, b"", b"", np.array(self.keys, np.uint64)[own].tobytes(), times[own].astype(np.int64).tobytes())] if len(own) else []
        elif hot is not None and len(hot):
            place = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
            known = hot[place] == hashes
            keys, sizes = np.array(self.keys, np.uint64)[who[known]], np.array(self.sizes, np.int64)[who[known]]
            sure = [(int(keys[0]) % self.groups, hashes[known].tobytes(), b"", keys.tobytes(), sizes.tobytes())] if len(keys) else []
            hashes, who = hashes[~known], who[~known]
        g = (mixed(hashes) % _U(self.groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        g, hashes, who = g[order], hashes[order].astype(self.kind), who[order]
        edges = np.flatnonzero(np.diff(g, prepend=-1, append=self.groups + 1)) if len(g) else np.zeros(1, int)
        keys, sizes = np.array(self.keys, np.uint64), np.array(self.sizes, np.int64)
        out = sure
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, place = np.unique(who[a:b], return_inverse=True)
            if len(own) and own[-1] == WITNESS:
                own = own[:-1]
                place = np.where(place == len(own), WITNESS, place)
            out.append((int(g[a]), hashes[a:b].tobytes(), place.astype(np.uint16).tobytes(), keys[own].tobytes(), sizes[own].tobytes()))
        self.clear()
        return pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True))], names=["g", "hashes", "who", "keys", "sizes"])


def _prefixes(groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(groups, np.uint32)
        for batch in batches:
            for _, _, data, offsets in steps(*utf8(batch.column(0))):
                for s in shingle_sets(data, offsets):
                    n = len(s)
                    if n and held.add(set_key(s), n, s[: n - least_overlap(n) + n // 4 + 1]):
                        yield held.rows(reduced=True)
        if held.count:
            yield held.rows(reduced=True)

    return send


def _postings(group: pd.DataFrame, kind: type) -> tuple[np.ndarray, ...]:
    """Hashes, whose, their sizes, and which are witnesses, of a group's rows."""
    hashes = np.frombuffer(b"".join(group["hashes"]), kind)
    parts = [(np.frombuffer(w, np.uint16), np.frombuffer(k, np.uint64), np.frombuffer(z, np.int64)) for w, k, z in zip(group["who"], group["keys"], group["sizes"], strict=True)]
    witness = np.concatenate([np.zeros(0, bool), *(w == WITNESS for w, _, _ in parts)])
    keys, sizes = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
    keys[~witness] = np.concatenate([np.zeros(0, np.uint64), *(k[w[w != WITNESS]] for w, k, _ in parts)])
    sizes[~witness] = np.concatenate([np.zeros(0, np.int64), *(z[w[w != WITNESS]] for w, _, z in parts)])
    return hashes, keys, sizes, witness


def _met(group: pd.DataFrame, kind: type) -> tuple[np.ndarray, ...]:
    """Of a group's postings, without repeats and by hash and set: hash, set, its size, number of sets with the hash; only hashes of two sets or more, or with a witness."""
    hashes, keys, sizes, witness = _postings(group, kind)
    seen = np.unique(hashes[witness])
    hashes, keys, sizes = hashes[~witness], keys[~witness], sizes[~witness]
    order = np.lexsort((keys, hashes))
    hashes, keys, sizes = hashes[order], keys[order], sizes[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]))[: len(hashes)]
    hashes, keys, sizes = hashes[new], keys[new], sizes[new]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    counts = np.diff(np.append(starts, len(hashes)))
    held = np.repeat(counts, counts)
    shared = (held > 1) | np.isin(hashes, seen)
    return hashes[shared], keys[shared], sizes[shared], held[shared]


BY_SET = "g long, keys binary, a binary, b binary, sizes binary"


def _by_set(groups: int, keys: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    """One row for each group of sets, with the arrays' parts as bytes."""
    g = (keys % _U(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    g = g[order]
    edges = np.flatnonzero(np.diff(g, prepend=-1, append=groups + 1)) if len(g) else np.zeros(1, int)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    columns = {"keys": keys, **more}
    return pd.DataFrame({"g": np.array([g[a] for a, _ in spans], np.int64), **{c: [v[order][a:b].tobytes() for a, b in spans] for c, v in columns.items()}})


def _count_shared(groups: int):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        sure = group["who"].str.len() == 0
        _, keys, _, _ = _met(group[~sure], np.uint32)
        own, times = np.unique(keys, return_counts=True)
        own = np.concatenate([own, *(np.frombuffer(k, np.uint64) for k in group["keys"][sure])])
        times = np.concatenate([times.astype(np.int64), *(np.frombuffer(z, np.int64) for z in group["sizes"][sure])])
        nothing = np.zeros(len(own), np.int8)
        return _by_set(groups, own, a=times, b=nothing, sizes=nothing)

    return count


def _add_shared(group: pd.DataFrame) -> pd.DataFrame:
    keys, place = np.unique(np.frombuffer(b"".join(group["keys"]), np.uint64), return_inverse=True)
    shared = np.bincount(place, np.frombuffer(b"".join(group["a"]), np.int64), len(keys)).astype(np.int64)
    return pd.DataFrame({"set_key": keys.view(np.int64), "shared": shared})


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in steps(*utf8(batch.column(0))):
            out += [(set_key(s), len(s), s.tobytes(), signature(s).tobytes()) for s in shingle_sets(data, offsets)]
        if out:
            keys, n, hashes, bits = zip(*out, strict=True)
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(hashes), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "n", "hashes", "bits"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that one of HOT_SHARE sets or more hold among those a task has at once, with the number of these sets."""
    held, many = [], 0

    def flush() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= max(2, len(held) // HOT_SHARE)
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], names=["hash", "sets"])

    for batch in batches:
        for hashes in batch.column(0).to_pylist():
            held.append(np.frombuffer(hashes, np.uint64))
            many += len(held[-1])
            if many >= GATHER:
                yield flush()
                held, many = [], 0
    if held:
        yield flush()


def hot_shingles(arrays: DataFrame, sets: int) -> np.ndarray:
    """Shingles known to be in more than one of HOT_SHARE sets, ascending: HOT_SHARE times a set's mean number of shingles at most."""
    counted = arrays.select("hashes").mapInArrow(tidy(_frequent), "hash long, sets long")
    often = counted.groupBy("hash").agg(F.sum("sets").alias("sets")).where(F.col("sets") > max(TILE, sets // HOT_SHARE))
    return np.sort(np.array([r["hash"] for r in often.select("hash").collect()], np.int64).view(np.uint64))


def _all_shingles(groups: int, hot: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(groups, np.uint64)
        for batch in batches:
            for key, n, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held.add(key & 0xFFFFFFFFFFFFFFFF, n, np.frombuffer(hashes, np.uint64)):
                    yield held.rows(hot=hot)
        if held.count:
            yield held.rows(hot=hot)

    return send


def _frequencies(groups: int):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        sure = group["who"].str.len() == 0
        hashes, keys, sizes, held = _met(group[~sure], np.uint64)
        more = [np.frombuffer(b"".join(group[c][sure]), kind) for c, kind in (("keys", np.uint64), ("hashes", np.uint64), ("sizes", np.int64))]
        rarity = np.append(held.astype(np.int64), np.full(len(more[0]), HOT))
        return _by_set(groups, np.append(keys, more[0]), a=np.append(hashes, more[1]), b=rarity, sizes=np.append(sizes, more[2]))

    return count


def _rare_prefixes(group: pd.DataFrame) -> pd.DataFrame:
    """The shared ones among each set's rarest shingles that must hold a partner's."""
    columns = {c: np.frombuffer(b"".join(group[c]), np.uint64 if c in ("keys", "a") else np.int64) for c in ("keys", "a", "b", "sizes")}
    order = np.lexsort((columns["a"], columns["b"], columns["keys"]))
    keys, hashes, n = columns["keys"][order], columns["a"][order], columns["sizes"][order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    shared = np.diff(np.append(starts, len(keys)))
    rank = np.arange(len(keys)) - np.repeat(starts, shared)
    alone = n - np.repeat(shared, shared)
    kept = rank < n - least_overlap(n) + 1 - alone
    return pd.DataFrame({"hash": hashes[kept].view(np.int64), "set_key": keys[kept].view(np.int64)})


# --- step 3 ----------------------------------------------------------------------------


def bands(n: np.ndarray) -> np.ndarray:
    """Number of the size band: sets that link are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log(BAND) + 1e-9).astype(np.int64)


def leader_pairs(n: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Places of pairs to verify among sets that share a shingle: each set with the first leader that may link with it."""
    left, out = np.argsort(n, kind="stable"), []
    while len(left) > 1:
        leader, left = left[0], left[1:]
        fits = bands(n[left]) <= bands(n[leader : leader + 1])[0] + 1
        fits[fits] = may_link(bits[left[fits]], n[left[fits]], bits[leader], n[leader])
        out += [(int(leader), int(x)) for x in left[fits]]
        left = left[~fits]
    return out


def _leaders(group: pd.DataFrame) -> pd.DataFrame:
    keys, place = np.unique(group["set_key"].to_numpy(), return_index=True)
    n = group["n"].to_numpy()[place]
    bits = np.frombuffer(b"".join(group["bits"].iloc[place]), np.uint8).reshape(len(keys), -1)
    posting = pd.DataFrame({"hash": group["hash"].to_numpy(), "block": group["block"].to_numpy(), "who": np.searchsorted(keys, group["set_key"].to_numpy())})
    posting = posting.drop_duplicates().sort_values(["hash", "block", "who"])
    who, names = posting["who"].to_numpy(), posting[["hash", "block"]].to_numpy()
    edges = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1, [len(who)]])
    pairs: set[tuple[int, int]] = set()
    seen: set[bytes] = set()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = who[a:b]
        if b - a < 2 or (name := own.tobytes()) in seen:
            continue
        seen.add(name)  # shingles of the same sets make the same pairs
        pairs.update(tuple(sorted((int(own[x]), int(own[y])))) for x, y in leader_pairs(n[own], bits[own]))
    found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": keys[found[:, 0]], "b": keys[found[:, 1]]})


def join_tile(arrays: list[np.ndarray], component: np.ndarray, may_meet: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (places) that join sets of different components; may_meet(x, others) says which pairs belong to the tile."""
    n = np.array([len(a) for a in arrays])
    width = min(1 << 15, 1 << int(8 * n.max()).bit_length())
    bits = np.zeros((len(n), width // 8), np.uint8)
    for i, hashes in enumerate(arrays):
        row = np.zeros(width, np.uint8)
        row[(hashes & _U(width - 1)).astype(np.int64)] = 1
        bits[i] = np.packbits(row)
    order = np.argsort(n, kind="stable")
    last = np.searchsorted(n[order], n[order] * DENOMINATOR // NUMERATOR, "right")  # larger ones can't link
    component, out = component.copy(), []
    for i, x in enumerate(order.tolist()):
        others = order[i + 1 : last[i]]
        others = others[component[others] != component[x]]
        others = others[may_meet(x, others)] if len(others) else others
        if not len(others):
            continue
        for y in others[may_link(bits[others], n[others], bits[x], n[x])].tolist():
            if component[y] != component[x] and links(arrays[x], arrays[y]):
                out.append((x, y))
                component[component == component[y]] = component[x]
    return out


def _tiles(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (_, top, kind, one, two), tile in group.groupby(["owner", "top", "kind", "one", "two"]):
        tile = tile.drop_duplicates("set_key")
        band, keys = tile["band"].to_numpy(), tile["set_key"].to_numpy()
        part = tile["big" if kind else "block"].to_numpy()  # sets of one part don't meet here

        def may_meet(x: int, others: np.ndarray, band=band, part=part, top=top, whole=not kind and one == two) -> np.ndarray:
            return ((band[others] == top) | (band[x] == top)) & (whole | (part[others] != part[x]))

        names = tile["component"].factorize()[0]
        found = join_tile([np.frombuffer(h, np.uint64) for h in tile["hashes"]], names, may_meet)
        out += [(keys[x], keys[y]) for x, y in found]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs (a, b) of set keys that pass the exact test."""
    part = lambda side, name: arrays.select(F.col("set_key").alias(side), F.col("hashes").alias(name)).dropDuplicates([side])
    both = pairs.distinct().join(part("a", "x"), "a").join(part("b", "y"), "b").select("a", "b", "x", "y")
    return save(both.mapInArrow(tidy(_verified), "a long, b long"))


def components(links_: DataFrame) -> DataFrame:
    """node, component (the least node reachable): least labels spread along links, then jump to the label's label.

    Each round writes its labels to the shared folder; rounds go with the logarithm of the longest path, about.
    """
    both = save(links_.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links_.select("b", "a")).where("node <> other").distinct())
    labels = save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        named = labels.select(F.col("node").alias("other"), F.col("component").alias("c"))
        near = join_skewed(both, named, "other").groupBy("node").agg(F.min("c").alias("near"))
        spread = save(labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was")))
        jump = spread.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = save(join_skewed(spread, jump, "to", "left").select("node", F.coalesce("further", "to").alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def joined_by(links_: DataFrame, joined: DataFrame) -> DataFrame:
    """node, component of `joined` and the links together: only components that a link joins take part in further rounds."""
    at = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    ends = join_skewed(save(join_skewed(links_, at("a"), "a", "left")), at("b"), "b", "left")
    ends = save(ends.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")))
    merged = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct())
    fresh = ends.where("a = c_a").select("a").union(ends.where("b = c_b").select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    nodes = save(joined.union(fresh.join(joined.select("node"), "node", "left_anti")))
    further = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return save(join_skewed(nodes, further, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def _led(rare: DataFrame, arrays: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Links (a, b) from one round of leaders, among the first sets of the components that hold a shingle."""
    heads = rare
    if joined is not None:
        named = joined.select(F.col("node").alias("set_key"), "component")
        held = rare.join(named, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
        heads = save(held.groupBy("hash", "component").agg(F.min("set_key").alias("set_key")).drop("component"))
    blocks = heads.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1").select("hash", F.ceil(F.col("held") / TILE).alias("blocks"))
    rows = save(join_skewed(heads, blocks, "hash").select("hash", "set_key", F.pmod(F.xxhash64("set_key"), "blocks").cast("int").alias("block")))
    tile = F.pmod(F.xxhash64("hash", "block"), F.lit(groups_for(rows.count(), LEADER_GROUP))).alias("tile")
    outline = arrays.select("set_key", "n", "bits").dropDuplicates(["set_key"])
    postings = rows.join(outline, "set_key").select(tile, "hash", "block", "set_key", "n", "bits")
    return _links(postings.groupBy("tile").applyInPandas(tidy(_leaders), "a long, b long"), arrays)


def _apart(rare: DataFrame, arrays: DataFrame, joined: DataFrame) -> DataFrame:
    """Links (a, b) that join components, from tiles of the sets whose rare shingles more than one component holds.

    Under each owner, sets of its largest component (big) and the others are cut into blocks. Blocks of
    others meet each other (kind 0) and those of the big (kind 1), so a large group that is one
    component already goes to one tile each, and is not met with itself.
    """
    named = joined.select(F.col("node").alias("set_key"), "component")
    held = save(rare.join(named, "set_key", "left").withColumn("component", F.coalesce("component", "set_key")))
    shared = held.groupBy("hash").agg(F.min("set_key").alias("owner"), F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d")
    members = save(join_skewed(held, shared.select("hash", "owner"), "hash").select("owner", "set_key", "component").distinct())
    sizes = members.groupBy("owner", "component").agg(F.count("*").alias("held")).groupBy("owner")
    largest = F.max(F.struct("held", "component"))
    blocks = lambda n: F.greatest(F.ceil(n / TILE), F.lit(1)).cast("int")
    sizes = sizes.agg(
        largest["component"].alias("largest"), blocks(largest["held"]).alias("big_blocks"), blocks(F.sum("held") - largest["held"]).alias("blocks")
    )
    size_band = F.floor(F.ln("n") / -math.log(BAND) + 1e-9).cast("int").alias("band")
    rows = join_skewed(members, sizes, "owner").join(arrays.select("set_key", "n", size_band).dropDuplicates(["set_key"]), "set_key")
    rows = rows.withColumn("big", F.col("component") == F.col("largest"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_key"), F.when(F.col("big"), F.col("big_blocks")).otherwise(F.col("blocks"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, one, two: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"))
    own = F.col("block")
    to_others = F.transform(each("blocks"), lambda j: place(0, F.least(own, j), F.greatest(own, j)))
    to_big = F.transform(each("big_blocks"), lambda j: place(1, own, j))
    from_big = F.transform(each("blocks"), lambda i: place(1, i, own))
    rows = rows.withColumn("to", F.explode(F.when(F.col("big"), from_big).otherwise(F.concat(to_others, to_big))))
    rows = rows.select("owner", "set_key", "component", "n", "band", "big", "block", "to.*", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("top"))
    groups = groups_for(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"], SHINGLE_GROUP)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("owner", "top", "kind", "one", "two"), F.lit(groups)))
    full = rows.join(arrays.select("set_key", "hashes").dropDuplicates(["set_key"]), "set_key")
    return save(full.drop("n").groupBy("tile").applyInPandas(tidy(_tiles), "a long, b long"))


# --- step 5 ----------------------------------------------------------------------------


def count_in_tile(arrays: list[np.ndarray], docs: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """For each set the documents of the sets in the tile that it links with; with `side`, only sets of different sides meet."""
    n = np.array([len(a) for a in arrays])
    order = np.argsort(n, kind="stable")
    arrays, n, docs = [arrays[i] for i in order], n[order], docs[order]
    side = None if side is None else side[order]
    width = min(1 << 13, 1 << int(4 * n.max()).bit_length())
    bits = np.zeros((len(n), width // 8), np.uint8)
    for i, hashes in enumerate(arrays):
        row = np.zeros(width, np.uint8)
        row[(hashes & _U(width - 1)).astype(np.int64)] = 1
        bits[i] = np.packbits(row)
    last = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, "right")  # larger ones can't link
    all_, place = np.unique(np.concatenate(arrays), return_inverse=True)
    starts = np.append(0, np.cumsum(n))
    mark, sums = np.zeros(len(all_), np.int32), np.zeros(len(n), np.int64)
    for i in range(len(n)):
        others = np.arange(i + 1, last[i])
        others = others if side is None else others[side[others] != side[i]]
        if not len(others):
            continue
        others = others[may_link(bits[others], n[others], bits[i], n[i])]
        if not len(others):
            continue
        if 4 * len(others) >= last[i] - i:  # many: all sorted arrays behind this one are met in one sweep
            own = place[starts[i] : starts[i + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[place[starts[i + 1] : starts[last[i]]]], starts[i + 1 : last[i]] - starts[i + 1])[others - i - 1]
            mark[own] = 0
            found = others[DENOMINATOR * both >= NUMERATOR * (n[i] + n[others] - both)]
        else:
            found = others[[links(arrays[i], arrays[j]) for j in others]]
        sums[i] += docs[found].sum()
        sums[found] += docs[i]
    out = np.zeros(len(n), np.int64)
    out[order] = sums
    return out


def _sum_tiles(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (_, _, _, one, two), tile in group.groupby(["component", "band", "kind", "one", "two"]):
        side = tile["side"].to_numpy() if one != two or tile["kind"].iloc[0] else None
        sums = count_in_tile([np.frombuffer(h, np.uint64) for h in tile["hashes"]], tile["docs"].to_numpy(), side)
        out.append(pd.DataFrame({"set_key": tile["set_key"].to_numpy(), "links": sums}))
    return pd.concat(out)


def link_sums(members: DataFrame, arrays: DataFrame) -> DataFrame:
    """set_key, links: documents of other sets that a set links with. `members`: sets (set_key, docs) of components of several (component, held).

    A component of up to LINK_TILE sets is a tile. A larger one is cut by band of size, and bands into
    blocks: kind 0 tiles have two blocks of a band (or one), kind 1 a block each of a band and the next.
    """
    size_band = F.floor(F.ln("n") / -math.log(BAND) + 1e-9).cast("int").alias("own_band")
    rows = save(members.join(arrays.select("set_key", "n", size_band).dropDuplicates(["set_key"]), "set_key"))
    whole_ = rows.where(F.col("held") <= LINK_TILE).select("set_key", "component", "docs", "n", *(F.lit(0).alias(c) for c in ("band", "kind", "one", "two", "side")))
    large = rows.where(F.col("held") > LINK_TILE).withColumn("cell", F.xxhash64("component", "own_band"))
    cells = large.groupBy("component", "own_band", "cell").agg(F.ceil(F.count("*") / LINK_TILE).cast("int").alias("blocks"))
    beside = lambda step, name: cells.select("component", (F.col("own_band") - step).alias("own_band"), F.col("blocks").alias(name))
    cells = cells.join(beside(1, "above"), ["component", "own_band"], "left").join(beside(-1, "below"), ["component", "own_band"], "left").drop("component", "own_band")
    dealt = join_skewed(large, cells, "cell").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    each = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    band, own = F.col("own_band"), F.col("block")
    place = lambda b, kind, one, two, side: F.struct(b.alias("band"), F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.cast("int").alias("side"))
    same = F.transform(each("blocks"), lambda j: place(band, 0, F.least(own, j), F.greatest(own, j), own > j))
    up = F.transform(each("above"), lambda j: place(band, 1, own, j, F.lit(0)))
    down = F.transform(each("below"), lambda i: place(band - 1, 1, i, own, F.lit(1)))
    dealt = dealt.withColumn("to", F.explode(F.concat(same, up, down))).select("set_key", "component", "docs", "n", "to.*")
    rows = whole_.unionByName(dealt)
    groups = groups_for(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"], SHINGLE_GROUP)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("component", "band", "kind", "one", "two"), F.lit(groups)))
    full = rows.join(arrays.select("set_key", "hashes").dropDuplicates(["set_key"]), "set_key")
    sums = full.drop("n").groupBy("tile").applyInPandas(tidy(_sum_tiles), "set_key long, links long")
    return save(sums.groupBy("set_key").agg(F.sum("links").alias("links")))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """Per document: key, n_shingles, component (the least key reachable by links, itself included) and n_links (documents that it links with; without `count_links` left out).

    Null or empty texts have no shingles, link with nothing and are components of their own. Rows
    with equal sets link, whatever their keys; keys may repeat or be null (a component of null keys
    only has a null component). Whole texts of any length are read; a set is held by one task. Only
    key and text are read, so other columns cannot clash; no rows in, no rows out.
    """
    docs = df.select(df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("t"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("text_key"))
    kind = docs.schema["k"].dataType.simpleString()
    summary = save(docs.select("k", "t", "text_key").mapInArrow(tidy(_summaries), f"k {kind}, text_key long, n long, set_key long"))
    sets = save(
        summary.where("n > 0").groupBy("set_key").agg(F.max("n").alias("n"), F.min("k").alias("least"), F.min(F.struct("k", "text_key")).alias("one"), F.count("*").alias("docs"))
    )
    sizes = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sets")).first()
    set_groups = groups_for(sizes["sets"], SET_GROUP)
    # 1: sets that may link at all
    sent = docs.select("t").mapInArrow(tidy(_prefixes(groups_for(sizes["n"] // 2, FILTER_GROUP))), POSTINGS)
    shared = sent.groupBy("g").applyInPandas(tidy(_count_shared(set_groups)), BY_SET).groupBy("g").applyInPandas(tidy(_add_shared), "set_key long, shared long")
    least = f"floor(ceil(n * {NUMERATOR} / {DENOMINATOR}) / 4) + 1"
    alive = save(sets.join(shared, "set_key").where(f"shared >= {least}").select(F.col("one.k").alias("k"), F.col("one.text_key").alias("text_key"), "n"))
    tokens = alive.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # their shingles as arrays
    names = alive.select(F.xxhash64("k", "text_key").alias("name"))
    named = docs.select("t", F.xxhash64("k", "text_key").alias("name"))
    arrays = save(join_checked(named, names, "name", "left_semi", "8").select("t").mapInArrow(tidy(_arrays), "set_key long, n long, hashes binary, bits binary"))
    # 2: rarest shingles
    groups = groups_for(tokens, SHINGLE_GROUP)
    hot = hot_shingles(arrays, sizes["sets"])
    counted = arrays.select("set_key", "n", "hashes").mapInArrow(tidy(_all_shingles(groups, hot)), POSTINGS).groupBy("g").applyInPandas(tidy(_frequencies(groups)), BY_SET)
    rare = save(counted.groupBy("g").applyInPandas(tidy(_rare_prefixes), "hash long, set_key long"))
    # 3 and 4: links enough to join what links
    joined = None
    for step in (*[_led] * ROUNDS, _apart):
        new = step(rare, arrays, joined)
        if joined is None:
            joined = components(new)
        elif not new.isEmpty():
            joined = joined_by(new, joined)
    # components by name, for sets and then for documents
    placed = sets.join(joined.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    placed = save(placed.select("set_key", "least", "docs", F.coalesce("component", "set_key").alias("component")))
    heads = placed.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("held"))
    final = save(join_skewed(placed, heads, "component"))
    own = F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("head")).alias("component")
    out = [F.col("k").alias(key), F.col("n").alias("n_shingles"), own]
    named = final.select("set_key", "head", "docs")
    if count_links:
        named = named.join(link_sums(final.where("held > 1").select("set_key", "component", "held", "docs"), arrays), "set_key", "left")
        out.append(F.when(F.col("n") == 0, 0).otherwise(F.col("docs") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    return join_skewed(summary, named, "set_key", "left").select(*out)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, of each component that with the least key only (of equal keys the first by text); rows without shingles all stay. Keys of any type, null keys last; columns of any name stay as they are."""
    rows = numbered(docs.select(docs[key].alias("k"), docs[text].alias("t"), whole(docs)), "n", "k", ["t"])
    heads = save(classes(rows, "n", "t", count_links=False).where(F.col("component") == F.col("n")).select("n"))
    return join_checked(rows.select("n", "row"), heads, "n", "left_semi", "8").select("row.*")
