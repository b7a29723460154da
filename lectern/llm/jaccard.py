"""Near duplicates by an exact Jaccard join of word shingles, with token-combination prefixes.

A document is the set of its shingles' 64-bit hashes. Documents with equal sets form a class with one
representative. Two representatives that are similar enough share some of their first tokens in hash order:
with prefixes extended by m tokens, at least m + 1. A rare shared token is indexed alone. Frequent ones are indexed
in combinations. Short sets: two of the m + 1 fall into one of m groups, and that pair of tokens is a key. Long
sets nearly always hold frequent tokens, and two tokens tell little about them: there the prefix is extended to all
tokens, which are dealt into more groups than similar sets can have differing tokens. Of the first D + 1 groups of a
set that aren't empty, where D tokens may differ, one is the same in both; all tokens of a group together are a key.
Documents that meet under a key are compared by size and by parity bitmaps, whose distance never
exceeds that of the sets, so that no link is lost; what passes is verified on whole sets. Two rounds keep groups
of near copies small. The first looks at a few keys of each document and verifies it with its most connected
likely partner only. The second looks at all keys, but only at those whose documents are still in different
components, and verifies all pairs across components there.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

FREQUENT = 4096  # documents from which on a token counts as frequent
APART = 180  # tokens; pairs of sets that may differ in more are the long ones, as BITS tell little about them
GROUP = 128  # tokens of a document for each group of token pairs
BITS = 512  # of a parity bitmap
BLOCK = 2048  # documents of one key that are compared with as many others in one task
NEAR = 24  # smaller keys are compared by shifting, without a matrix
SOON = 6  # shared tokens of a document that the first round looks at
LINKS = 200_000  # links whose components one task may find; beyond, rounds over all executors
FEW = 4  # likely pairs a document, on average, that are all verified at once
TEXT = 600_000  # characters that are split at once

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_FAR = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as far as a task needs them."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def forget(cls) -> None:
        cls.up = cls.down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            ones = np.full(size, _MUL)
            ones[0] = 1
            cls.up = np.cumprod(ones)
            ones = np.full(size, np.uint64(_INV))
            ones[0] = 1
            cls.down = np.cumprod(ones)
        return cls.up, cls.down


common.at_task_end(_Powers.forget)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_CODE[65:91] = _CODE[97:123]  # A-Z count as a-z


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text's bytes."""
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for all words if there are fewer, none without words."""
    out: list[np.ndarray] = []
    for a, b in common.blocks(texts, TEXT):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        hashes, start = _word_hashes(b"\n".join(parts))
        cut = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        shingles = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            shingles = _mix(shingles * _MUL + hashes[k : len(hashes) - words + 1 + k]) if len(shingles) else shingles
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s >= words:
                out.append(np.unique(shingles[s : e - words + 1]))
            elif e > s:
                x = np.zeros(1, np.uint64)
                for h in hashes[s:e]:
                    x = _mix(x * _MUL + h)
                out.append(x + np.uint64(e - s))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _groups(n: np.ndarray | int):
    """How many groups the frequent tokens of a set of n fall into: a power of two."""
    return 1 << np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / GROUP)).astype(int))


def _parity(own: np.ndarray) -> bytes:
    """For each of BITS places the parity of the tokens there."""
    return np.packbits(np.bincount((own >> np.uint64(9)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes() if len(own) else b"\0" * (BITS // 8)


def _wide(own: np.ndarray) -> bytes:
    """The same over two to four places a token, for the last look at a pair before whole sets travel."""
    bits = BITS << max(0, int(np.ceil(np.log2(max(2 * len(own), 1) / BITS))))
    return np.packbits(np.bincount((own >> np.uint64(9)).astype(np.int64) % bits, minlength=bits) & 1).tobytes() if len(own) else b""


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """The distance of two bitmaps; the larger one is folded to the smaller one's size."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


class Rule:
    """A threshold as a fraction, and the sizes and distances it allows."""

    def __init__(self, words: int, least: Fraction):
        self.words, self.up, self.down = words, least.numerator, least.denominator
        apart = self.down - self.up
        self.long = max(2, APART * (self.up + self.down) // (2 * apart)) if apart else 1 << 62  # pairs are long if the larger set has so many tokens

    def least_common(self, n):
        return -(-self.up * n // self.down)

    def upper(self, n: int) -> int:
        """The largest partner of a set of n."""
        return self.down * n // self.up

    def prefix(self, own: np.ndarray) -> np.ndarray:
        """For short pairs: the first tokens in hash order, extended for the pairs of frequent ones."""
        n = len(own)
        return own[: n - self.least_common(n) + 1 + int(_groups(self.upper(n)))] if 0 < n < self.long else own[:0]

    def parts(self, n: int) -> int:
        """Groups of all tokens, for a pair whose larger set has n: at least a fifth more than tokens that may differ.

        Of sets of this size far more than that many groups are not empty, but for a chance far below that of two equal
        64-bit hashes.
        """
        return 1 << (6 * self.most_apart(n, n) // 5).bit_length()

    def combinations(self, own: np.ndarray) -> np.ndarray:
        """For long pairs: keys of the first groups that aren't empty, for all numbers of groups that a partner may ask for."""
        n, out = len(own), []
        low, high = max(n, self.long), self.upper(n)
        if not n or high < low:
            return own[:0]
        mixed = _mix(own ^ _FAR)
        for m in sorted({self.parts(low), self.parts(high)}):
            group = own & np.uint64(m - 1)
            order = np.argsort(group, kind="stable")
            group = group[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            keys = _mix(np.add.reduceat(mixed[order], first) * _MUL + group[first] + np.uint64(m))
            a, b = low, high
            while a < b:  # the largest set of a pair that asks for m groups
                c = (a + b + 1) // 2
                a, b = (c, b) if self.parts(c) <= m else (a, c - 1)
            out.append(keys[: self.most_apart(a, a) + 1])
        return np.concatenate(out)

    def most_apart(self, a, b):
        """The greatest symmetric difference of linked sets of these sizes: (1 - t) / (1 + t) of both."""
        return (self.down - self.up) * (a + b) // (self.down + self.up)


def sets_table(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, number of shingles, fingerprints of the set, parity bitmaps, prefixes and combinations of every document."""
    source = documents.select("doc_id", F.col("text").alias("_shingled"))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 250):
                part = batch.slice(s, 250)
                sets = shingle_sets(part.column(1).to_pylist(), rule.words)
                columns = [
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_signed(_mix(x).sum()) if len(x) else 0 for x in sets], pa.int64()),
                    pa.array([_signed((_mix(x ^ _MUL) * _MUL).sum()) if len(x) else 0 for x in sets], pa.int64()),
                    pa.array([_parity(x) for x in sets], pa.binary()),
                    pa.array([_wide(x) for x in sets], pa.binary()),
                    *(pa.array([f(x).astype(np.int64) for x in sets], pa.list_(pa.int64())) for f in (rule.prefix, rule.combinations)),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "f1", "f2", "parity", "wide", "prefix", "combinations"])

    return source.mapInArrow(common.lean(run), "doc_id long, n long, f1 long, f2 long, parity binary, wide binary, prefix array<long>, combinations array<long>")


def _keys(reps: DataFrame, rule: Rule) -> DataFrame:
    """(key, rep) rows: rare tokens alone, frequent ones in combinations; tokens of one row are left out."""
    several = reps.where(F.col("n") > 1)
    tokens = several.select("rep", F.explode("prefix").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("docs")).where(F.col("docs") > 1)
    shared = common.written(tokens.join(counts, "token"), "tokens")
    rare = shared.where(F.col("docs") < FREQUENT).select(F.col("token").alias("key"), "rep")
    wide = several.select("rep", F.explode("combinations").alias("key"))
    twice = wide.groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") > 1).select("key")
    wide = common.written(wide.join(twice, "key").select("key", "rep"), "combinations")
    many = shared.where(F.col("docs") >= FREQUENT).groupBy("rep").agg(F.collect_list("token").alias("tokens"))  # at most a prefix
    many = many.join(several.select("rep", "n"), "rep")

    def pairs(batches):
        for batch in batches:
            keys, at = [], []
            for i, (n, tokens) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x = np.sort(np.array(tokens, np.int64).astype(np.uint64))
                for m in {int(_groups(n)), int(_groups(rule.upper(n)))}:
                    group = (x >> np.uint64(20)) % np.uint64(m)
                    for g in np.unique(group):
                        own = x[group == g]
                        a, b = np.triu_indices(len(own), 1)
                        found = _mix(_mix(own[a] * _MUL + own[b]) + np.uint64(m))
                        keys.append(found.astype(np.int64))
                        at.append(np.full(len(found), i))
                    if sum(map(len, keys)) > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(at)))], names=["key", "rep"])
                        keys, at = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(at)))], names=["key", "rep"])

    keys = common.written(rare.union(wide).union(many.select("rep", "n", "tokens").mapInArrow(common.lean(pairs), "key long, rep long")), "keys")
    common.drop(shared, wide)
    return keys


def _dealt(keys: DataFrame, more: DataFrame) -> DataFrame:
    """Keys with what is known of their documents, dealt so that a task compares two blocks of one key at most.

    A key of more than BLOCK documents is cut into blocks, and each pair of blocks is its own group.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = keys.join(counts, "key").join(more, "rep")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", F.explode(others))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.withColumn("part", low * F.col("blocks") + high).withColumn("side", (F.col("block") == high).cast("int"))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "side", "n", "rep")


def _survivors(rule: Rule, n: np.ndarray, side: np.ndarray, parity: np.ndarray):
    """Index pairs of one group whose sizes and bitmaps allow a link. Sorted by side, then size."""
    cut = int(np.searchsorted(side, 1)) if side[0] != side[-1] else 0
    for s in range(0, cut or len(n), 256):
        e = min(s + 256, cut or len(n))
        first, last = (cut, len(n)) if cut else (s, len(n))
        other = slice(first, last)
        if not cut:
            last = int(np.searchsorted(n, rule.upper(int(n[e - 1])), "right"))
            other = slice(first, last)
        apart = np.zeros((e - s, last - first), np.int32)
        for w in range(parity.shape[1]):
            apart += np.bitwise_count(parity[s:e, w, None] ^ parity[None, other, w])
        a, b = n[s:e, None], n[None, other]
        good = (apart <= rule.most_apart(a, b)) & (_sizes_fit(rule, a, b))
        if not cut:
            good &= np.arange(first, last)[None, :] > np.arange(s, e)[:, None]
        i, j = np.nonzero(good)
        yield i + s, j + first


def _sizes_fit(rule: Rule, a, b):
    return (rule.up * np.maximum(a, b) <= rule.down * np.minimum(a, b))


def _compare(rule: Rule, rows: DataFrame, linked: bool) -> DataFrame:
    """Candidate pairs (a, b) of each group. With ``linked`` (component known) all across components; without, the
    most connected partner of each document of a large group, and all pairs of a small one."""

    def group(rep, n, side, comp, parity):
        i, j = (np.concatenate(x) for x in zip(*_survivors(rule, n, side, parity), strict=True))
        if linked:
            keep = comp[i] != comp[j]
            return rep[i[keep]], rep[j[keep]]
        degree = np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((rep[b], -degree[b], a))
        a, b = a[order], b[order]
        first = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
        return rep[a[first]], rep[b[first]]

    def run(batches):
        def finish(parts):
            key, part, side, n, rep, comp = (np.concatenate([p[k] for p in parts]) for k in range(6))
            parity = np.concatenate([p[6] for p in parts])
            if not len(key):
                return
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            gid = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            small = size[gid] <= NEAR
            found = []
            for d in range(1, NEAR):  # small groups: each row with the one d places on
                at = np.flatnonzero(small[:-d] & (gid[:-d] == gid[d:])) if len(gid) > d else np.zeros(0, np.int64)
                if not len(at):
                    break
                ok = _sizes_fit(rule, n[at], n[at + d]) & ((comp[at] != comp[at + d]) if linked else True)
                at = at[ok]
                apart = np.bitwise_count(parity[at] ^ parity[at + d]).sum(1)
                at = at[apart <= rule.most_apart(n[at], n[at + d])]
                found.append((rep[at], rep[at + d]))
            for g in np.flatnonzero(size > NEAR).tolist():
                s = slice(start[g], start[g] + size[g])
                if linked and comp[s].min() == comp[s].max():
                    continue
                found.append(group(rep[s], n[s], side[s], comp[s], parity[s]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        kept: list = []
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            raw = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(own[0]), BITS // 64)
            if not len(own[0]):
                continue
            last = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from finish([*kept, [x[:cut] for x in (*own, raw)]])
                kept = []
            elif kept and (kept[-1][0][-1], kept[-1][1][-1]) != (own[0][0], own[1][0]):
                yield from finish(kept)
                kept = []
            kept.append([x[cut:] for x in (*own, raw)])
        if kept:
            yield from finish(kept)

    columns = rows.select("key", F.col("part").cast("long"), F.col("side").cast("long"), "n", "rep", "comp", "parity")
    return columns.mapInArrow(common.lean(run), "a long, b long").dropDuplicates(["a", "b"])


def _sets(pairs: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id and whole set of both ends of pairs (a, b), made where the texts are read and written once."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    size = 1 << 23
    shipped = pairs.sparkSession.sparkContext.broadcast(common.bitmap(ends, "doc_id", size))
    source = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("_at"), "text")

    def make(batches):
        for batch in batches:
            batch = batch.filter(pa.array(common.hit(shipped.value, batch.column(1).to_numpy(zero_copy_only=False))))
            for s in range(0, batch.num_rows, 250):
                part = batch.slice(s, 250)
                sets = shingle_sets(part.column(2).to_pylist(), rule.words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "tokens"])

    sets = source.mapInArrow(common.lean(make), "doc_id long, tokens binary").join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = common.written(sets, "sets")
    shipped.destroy()
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")

    def test(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                good.append(rule.down * shared >= rule.up * (len(merged) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return common.written(both.select("a", "b", "x", "y").mapInArrow(common.lean(test), "a long, b long"), "links")


def _possible(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose wide bitmaps allow a link; they are a small part of the sets."""
    wide = reps.select("rep", "n", "wide").dropDuplicates(["rep"])
    both = pairs.join(wide.toDF("a", "n", "x"), "a").join(wide.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def test(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            apart = [_apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= rule.most_apart(n, m)))

    return both.mapInArrow(common.lean(test), "a long, b long")


def _forest(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs, each document's one with its most connected partner, as (document, partner)."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
    degree = both.groupBy(F.col("b")).agg(F.count("*").alias("degree"))
    best = both.join(degree, "b").groupBy("a").agg(F.max(F.struct("degree", (-F.col("b")).alias("minus"))).alias("_m"))
    best = best.select("a", (-F.col("_m.minus")).alias("b"))
    # two that chose each other are one pair
    other = best.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a < b")
    return best.join(other, ["a", "b"], "left_anti")


def _joined(batches):
    """All links of one task: each node with the smallest one of its tree."""
    up: dict[int, int] = {}

    def find(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over (a, b), for nodes of links.

    Up to LINKS links one task joins nodes to trees. More go through rounds of large and small stars: each round is a few aggregations over the links; the number of rounds grows with the logarithm of the
    longest chain. Only a count and two sums of hashes reach the driver; links that they tell to be as before are final.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = common.written(edges, "edges")
    if edges.count() <= LINKS:
        return common.written(edges.coalesce(1).mapInArrow(_joined, "node long, comp long"), "components")
    mark = F.xxhash64("u", "v")
    state = lambda own: own.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, common.written(small, "edges")
        common.drop(old, large)
        same, before = (now := state(edges)) == before, now
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(documents: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``.

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``least``; component_id is the
    smallest doc_id that is reachable by links, the document's own if there is none. Null, empty and wordless
    texts have an empty set and no link. Rows of one doc_id with different texts count as documents that
    share an id; a null doc_id is linked with nothing.
    """
    rule = Rule(words, least)
    own = common.written(sets_table(documents, rule), "shingles")
    named = own.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = common.written(named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = named.dropDuplicates(["doc_id"]) if not classes.groupBy("rep").count().where("count > 1").isEmpty() else named
    reps = firsts.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    keys = _keys(reps, rule)
    about = reps.select("rep", "n", "parity").dropDuplicates(["rep"])
    soon = keys.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("key")), 1, SOON).alias("_k")).select("rep", F.explode("_k").alias("key"))
    likely = common.written(_compare(rule, _dealt(soon, about.withColumn("comp", F.lit(0).cast("long"))), False), "likely")
    tree = common.written(_forest(common.written(_possible(likely, reps, rule), "possible")), "tree")
    sets = _sets(tree, documents, rule)
    links = _verify(tree, sets, rule)
    common.drop(sets, tree, likely)
    comps = components(links)
    known = keys.join(comps, keys.rep == comps.node, "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    known = common.written(known, "known")
    common.drop(keys)
    apart = known.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("key")
    open_keys = known.join(apart, "key", "left_semi")
    states = about.join(comps, about.rep == comps.node, "left").select("rep", "n", "parity", F.coalesce("comp", "rep").alias("comp"))
    left = common.written(_possible(_compare(rule, _dealt(open_keys.select("key", "rep"), states), True), reps, rule), "left")
    common.drop(known)
    sets = _sets(left, documents, rule)
    # few pairs are verified at once, many a tree's worth at a time: most others then lie within one component
    while size := left.count():
        ends = left.select(F.col("a").alias("e")).union(left.select("b")).agg(F.approx_count_distinct("e")).first()[0]
        tree = left if size <= FEW * ends else common.written(_forest(left), "tree")
        links = links.union(_verify(tree, sets, rule))
        comps = components(links)
        if tree is left:
            break
        done = tree.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(done, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end, "left")
        old, left = left, common.written(rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"), "left")
        common.drop(old, tree)
    common.drop(sets, left)
    named_classes = classes.join(comps, classes.rep == comps.node, "left").select("n", "f1", "f2", F.coalesce("comp", "rep").alias("component_id"))
    joined = own.select("doc_id", "n", "f1", "f2").join(named_classes, ["n", "f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at three words and a similarity of 0.9."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
