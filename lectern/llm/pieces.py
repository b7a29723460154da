"""Encoding into SentencePiece pieces and back, with the N best segmentations.

A forward Viterbi pass over the lattice of pieces gives the best score of every prefix. These are the exact
heuristics of an A-star search from the end of the text to its start, which therefore meets complete
segmentations in order of their score. Pieces never reach from one word into the next, so words are searched
apart, and a text's N best come from its words' N best. ``nbest`` searches with a heap for any N. ``encode``
needs two of each distinct word and searches many words of one length in lockstep, each with its own open list.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

SPACE = "▁"
PENALTY = 10.0  # a character without a piece scores so much below the lowest piece
KEPT = 600_000  # distinct words a task remembers; it starts anew beyond that
CELLS = 1_000_000  # lattice entries at once
TEXT = 4_000_000  # characters that are encoded at once
UNIT = re.compile(" *[^ ]+| +")

_B = np.uint64(0x9E3779B97F4A7C15)


class Solved:
    """What is known of words, by number: where their best and second best ids stand, their scores, and exactness."""

    FIELDS = (("at", np.int64), ("count", np.int64), ("at2", np.int64), ("count2", np.int64), ("best", float), ("loss", float), ("exact", bool))

    def __init__(self):
        self.number: dict[str, int] = {}
        self.surface: dict[int, str] = {}  # of words that pieces don't give back as they were
        self.ids = np.zeros(1 << 12, np.uint32)
        self.used = 0
        for name, kind in self.FIELDS:
            setattr(self, name, np.zeros(1 << 10, kind))

    def extend(self, words: list[str], columns: dict[str, np.ndarray]) -> range:
        first = len(self.number)
        own = range(first, first + len(words))
        self.number.update(zip(words, own, strict=True))
        while own.stop > len(self.at):
            for name, _ in self.FIELDS:
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        for name, value in columns.items():
            getattr(self, name)[own.start : own.stop] = value
        return own

    def put(self, ids: np.ndarray) -> int:
        """Append ids; their first place."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.used
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at


class Pieces:
    """A vocabulary file's pieces and scores."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.names = [own.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        score = np.array([own.get_score(i) for i in range(n)])
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if own.is_byte(i)}
        self.unknown = own.unk_id()
        letters = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in self.names]
        self.sizes = np.array([len(x) for x in letters])  # of all names, one after the other
        self.begins, self.letters = np.cumsum(self.sizes) - self.sizes, np.concatenate(letters)
        self.longest = max(len(self.names[i]) for i in plain)
        self.apart = not any(SPACE in self.names[i].lstrip(SPACE) for i in plain)
        hashes, ids, begun = [], [], np.zeros(1 << 22, bool)
        for size in sorted({len(self.names[i]) for i in plain}):
            own_ids = [i for i in plain if len(self.names[i]) == size]
            x = self._mixed(self._chars([self.names[i] for i in own_ids], size))
            h = x[:, 0] * _B
            for k in range(1, size):
                begun[(h >> np.uint64(42)).astype(np.int64)] = True
                h = self._longer(h, x[:, k])
            hashes.append(h)
            ids.append(np.array(own_ids))
        hashes, ids = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(hashes)
        self.begun = begun  # what longer pieces begin with, by the upper bits of its hash
        self.hashes, self.ids, self.scores = hashes[order], ids[order], score[ids[order]]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.low = float(self.scores.min()) - PENALTY
        self.is_byte = {i: b for b, i in self.bytes.items()}
        self.by_name = {self.names[i]: int(i) for i in self.ids}
        self.solved = Solved()

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    def forget(cls) -> None:
        for own in cls._loaded.values():
            own.solved = Solved()

    @staticmethod
    def _chars(words: list[str], size: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)

    @staticmethod
    def _mixed(chars: np.ndarray) -> np.ndarray:
        x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    @staticmethod
    def _longer(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The hash of a string with one character more."""
        return (h ^ x ^ (h >> np.uint64(31))) * _B

    def _lattice(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each length (last axis, from 1) that ends at each place (0 to the length).

        A start is followed only as long as some piece begins with what has been read from there. A character without
        a piece has the lowest score and id -1.
        """
        n, size = chars.shape
        wide = min(self.longest, size)
        score, ids = np.full((n, size + 1, wide), -np.inf), np.full((n, size + 1, wide), -1, np.int32)
        x = self._mixed(chars)
        row, at = (i.ravel() for i in np.indices((n, size)))
        h = (x * _B).ravel()
        used = 1
        for k in range(wide):
            i = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, h[i]), len(self.hashes) - 1)
            good = self.hashes[found] == h[i]
            i, found = i[good], found[good]
            if len(i):
                score[row[i], at[i] + k + 1, k], ids[row[i], at[i] + k + 1, k] = self.scores[found], self.ids[found]
                used = k + 1
            i = np.flatnonzero(self.begun[(h >> np.uint64(42)).astype(np.int64)] & (at + k + 1 < size))
            if not len(i):
                break
            row, at = row[i], at[i]
            h = self._longer(h[i], x[row, at + k + 1])
        score[:, 1:, 0][score[:, 1:, 0] == -np.inf] = self.low
        return score[:, :, :used], ids[:, :, :used]

    @staticmethod
    def _forward(score: np.ndarray) -> np.ndarray:
        """The best score up to every place."""
        n, places, wide = score.shape
        v = np.full((n, places), -np.inf)
        v[:, 0] = 0
        for j in range(1, places):
            m = min(j, wide)
            v[:, j] = (v[:, j - m : j] + score[:, j, :m][:, ::-1]).max(1)
        return v

    def _together(self, chars: np.ndarray) -> tuple:
        """The two best segmentations of many words of one length, by A-star in lockstep.

        Every word has an open list of its own, a block of entries for each expansion with the block's best. A round takes
        the best entry of each list, of equal ones the one that came last, and expands it; one at the start of the
        word is a complete segmentation. Returns ids with their number, for best and second best, and both scores.
        """
        n, size = chars.shape
        score, ids = self._lattice(chars)
        v, wide = self._forward(score), score.shape[2]
        ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full((n, wide), -np.inf), v], 1), wide, 1)[:, :, ::-1]  # the scores before each place, nearest first
        room = 8
        bounds, top = np.empty((room, n, wide)), np.empty((room, n))  # by expansion: its entries and the best of them
        pos, cost, parent, via = (np.empty((room, n), t) for t in (np.int64, float, np.int64, np.int64))  # its place, score so far, the entry taken
        ends = [(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)) for _ in range(2)]
        found = np.zeros(n, np.int64)
        live = grown = np.arange(n)
        at, g, by, k = np.full(n, size), np.zeros(n), np.full(n, -1), np.full(n, -1)
        r = 0
        while len(live):
            if r == room:
                room *= 2
                bounds, top, pos, cost, parent, via = (np.concatenate([x, np.empty_like(x)]) for x in (bounds, top, pos, cost, parent, via))
            pos[r, grown], cost[r, grown], parent[r, grown], via[r, grown] = at, g, by, k
            bound = g[:, None] + score[grown, at] + ahead[grown, at]
            bounds[r, grown] = bound
            top[r] = -np.inf
            top[r, grown] = bound.max(1, initial=-np.inf)
            by = r - top[r::-1, live].argmax(0)
            f = top[by, live]
            left = f > -np.inf
            live, by, f = live[left], by[left], f[left]
            own = bounds[by, live]
            k = wide - 1 - own[:, ::-1].argmax(1)
            own[np.arange(len(live)), k] = -np.inf
            bounds[by, live], top[by, live] = own, own.max(1, initial=-np.inf)
            place = pos[by, live]
            at, g = place - k - 1, cost[by, live] + score[live, place, k]
            done = at == 0
            for rank in (0, 1):
                i = np.flatnonzero(done & (found[live] == rank))
                for table, value in zip(ends[rank], (by, k, f), strict=True):
                    table[live[i]] = value[i]
            found[live[done]] += 1
            grown, at, g, by, k = live[~done], at[~done], g[~done], by[~done], k[~done]
            live = live[found[live] < 2]
            r += 1
        first, count = self._traced(ends[0], found > 0, ids, pos, parent, via)
        second, count2 = self._traced(ends[1], found > 1, ids, pos, parent, via)
        return first, count, second, count2, ends[0][2], ends[1][2]

    @staticmethod
    def _traced(end: tuple, met: np.ndarray, ids: np.ndarray, pos: np.ndarray, parent: np.ndarray, via: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of complete segmentations, from the entry that reached the start of a word up to the word's end."""
        into, count = np.full((len(met), ids.shape[1] - 1), -2, np.int32), np.zeros(len(met), np.int64)
        words = np.flatnonzero(met)
        by, k = end[0][words], end[1][words]
        while len(words):
            into[words, count[words]] = ids[words, pos[by, words], k]
            count[words] += 1
            by, k = parent[by, words], via[by, words]
            going = by >= 0
            words, by, k = words[going], by[going], k[going]
        return into, count

    def search(self, word: str, best: int) -> list[tuple[list[int], float]]:
        """A-star with a heap: the ``best`` best segmentations of one word as ids, best first, with their scores."""
        inner = word.replace(" ", SPACE)
        size = len(inner)
        score, ids = self._lattice(self._chars([inner], size))
        v, score, ids = self._forward(score)[0], score[0], ids[0]
        heap, count = [(-v[size], 0, size, 0.0, None)], 0
        out = []
        while heap and len(out) < best:
            f, _, p, g, path = heapq.heappop(heap)
            if p == 0:
                own = []
                while path is not None:
                    own += [path[0]] if path[0] >= 0 else self._fallback(inner[path[1]])
                    path = path[2]
                out.append((own, -f))
                continue
            for k in np.flatnonzero(score[p][:p] > -np.inf).tolist():
                count += 1
                cost = g + score[p, k]
                heapq.heappush(heap, (-(cost + v[p - k - 1]), -count, p - k - 1, cost, (int(ids[p, k]), p - 1, path)))
        return out

    def _fallback(self, char: str) -> list[int]:
        """The character's bytes, if the vocabulary has them."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def _filled(self, ids: np.ndarray, count: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids, ``count`` a word and covering its ``chars``, with the fallback of characters without a piece; and their numbers."""
        gaps = np.flatnonzero(ids < 0)
        if not len(gaps):
            return ids, count
        sizes = np.where(ids < 0, 1, self.sizes[ids])
        missing, kind = np.unique(chars[count > 0].ravel()[(np.cumsum(sizes) - sizes)[gaps]], return_inverse=True)
        instead = [self._fallback(chr(c)) for c in missing.tolist()]
        times = np.ones(len(ids), np.int64)
        times[gaps] = np.array([len(x) for x in instead])[kind]
        out = np.repeat(ids, times)
        out[out < 0] = [i for j in kind.tolist() for i in instead[j]]
        edge = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(edge)

    def _given_back(self, ids: np.ndarray, count: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Which words the names of their ids, ``count`` a word, spell as they are."""
        n, size = chars.shape
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        same = np.diff(ends[np.concatenate([[0], np.cumsum(count)])]) == size
        of = np.repeat(same, count)
        ids, sizes = ids[of], sizes[of]
        spelt = self.letters[np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        same[same] = (spelt.reshape(-1, size) == chars[same]).all(1)
        return same

    def solve(self, words: list[str]) -> None:
        """Add the two best segmentations of words (with their leading spaces) to those remembered."""
        by: dict[int, list[str]] = {}
        own = self.solved
        for w in words:
            by.setdefault(len(w), []).append(w)
        for size, group in by.items():
            step = max(1, CELLS // ((size + 1) * min(self.longest, size)))
            for s in range(0, len(group), step):
                part = group[s : s + step]
                inner = [w.replace(" ", SPACE) for w in part]
                chars = self._chars(inner, size)
                first, count, second, count2, best, next_best = self._together(chars)
                places = {}
                for name, ids, n in (("", first, count), ("2", second, count2)):
                    x, n = self._filled(ids[np.arange(size) < n[:, None]], n, chars)
                    at = own.put(x)
                    places |= {f"at{name}": at + np.cumsum(n) - n, f"count{name}": n}
                    same = self._given_back(x, n, chars) if not name else same
                numbers = own.extend(part, places | {"best": best, "loss": best - next_best, "exact": True})
                for i in np.flatnonzero(~same).tolist():  # byte pieces, for one
                    k = numbers[i]
                    text = self._surface(own.ids[own.at[k] : own.at[k] + own.count[k]].tolist())
                    own.exact[k] = text == part[i]
                    if text != part[i]:
                        own.surface[k] = text

    def _surface(self, ids: list[int]) -> str:
        raw = bytearray()
        for i in ids:
            b = self.is_byte.get(i)
            if b is None:
                raw += self.names[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")
            else:
                raw.append(b)
        return raw.decode("utf-8", "replace" if b"\xed" not in raw else "surrogatepass")

    def split(self, text: str) -> list[str]:
        """The words of a normalised text, each with the spaces before it; all of it if pieces may span words."""
        return (UNIT.findall(text) if self.apart else [text]) if text else []

    @staticmethod
    def normalised(text: str | None) -> str:
        """The model's own rule: a space in front, the mark of spaces counts as one. Null or empty: empty."""
        return " " + text.replace(SPACE, " ") if text else ""

    def known(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words, all of which are solved now, and how many words each text has."""
        if len(self.solved.number) > KEPT:
            self.solved = Solved()
        split = [self.split(self.normalised(t)) for t in texts]
        new = sorted(set().union(*split).difference(self.solved.number))
        if new:
            self.solve(new)
        get = self.solved.number.__getitem__
        return np.array([i for x in split for i in map(get, x)], np.int64), np.array([len(x) for x in split], np.int64)

    def gathered(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids that stand at these places, one run after the other."""
        total = np.cumsum(count)
        if not len(total) or not total[-1]:
            return self.solved.ids[:0]
        return self.solved.ids[np.repeat(at - (total - count), count) + np.arange(total[-1])]

    def nbest(self, text: str, n: int) -> list[tuple[list[int], float]]:
        """The n best segmentations of a whole text with their scores.

        From the best choice of every word, combinations are met in order of their loss.
        """
        split = self.split(self.normalised(text))
        each = {w: self.search(w, n) for w in set(split)}
        words = [each[w] for w in split]
        start = sum(w[0][1] for w in words)
        loss = [[w[0][1] - s for _, s in w] for w in words]
        order = sorted((k for k in range(len(words)) if len(loss[k]) > 1), key=lambda k: (loss[k][1], k))
        # a state changes some of the first words of ``order``; its last change is at place ``last``
        heap: list[tuple[float, tuple]] = [(0.0, ())]
        out = []
        while heap and len(out) < n:
            lost, change = heapq.heappop(heap)
            choice = {order[a]: b for a, b in change}
            out.append(([i for k, w in enumerate(words) for i in w[choice.get(k, 0)][0]], start - lost))
            last, own = change[-1] if change else (-1, 0)
            if change and own + 1 < len(loss[order[last]]):
                heapq.heappush(heap, (lost - loss[order[last]][own] + loss[order[last]][own + 1], (*change[:-1], (last, own + 1))))
            if last + 1 < len(order):
                heapq.heappush(heap, (lost + loss[order[last + 1]][1], (*change, (last + 1, 1))))
                if change and own == 1:
                    heapq.heappush(heap, (lost - loss[order[last]][1] + loss[order[last + 1]][1], (*change[:-1], (last + 1, 1))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: byte pieces join to characters, marks become spaces, the first space goes."""
        text = self._surface(list(ids))
        return text[1:] if text.startswith(" ") else text


common.at_task_end(Pieces.forget)


def encode(documents: DataFrame, path: str, keep: tuple = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Each text's best and second best segmentation and whether decoding gives the text back.

    Columns beside ``keep``: n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), best_score, second_score
    and second_ids_crc32 (null without a second one) and round_trip; with ``with_ids`` also ids and second_ids.
    Null counts as empty: no piece, score 0. Repeated rows are encoded alike. Columns in ``keep`` with the name of an
    added one are refused. One pass without a shuffle.
    """
    n = len(keep)
    common.fresh(list(keep), ["n_pieces", "ids_crc32", "best_score", "second_score", "second_ids_crc32", "round_trip", *(("ids", "second_ids") if with_ids else ())])
    source = documents.select(*keep, F.col("text").alias("_encoded"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    schema += ", n_pieces long, ids_crc32 long, best_score double, second_score double, second_ids_crc32 long, round_trip boolean"
    names = ["n_pieces", "ids_crc32", "best_score", "second_score", "second_ids_crc32", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    if with_ids:
        schema += ", ids array<int>, second_ids array<int>"
        names, kinds = [*names, "ids", "second_ids"], [*kinds, pa.list_(pa.int32()), pa.list_(pa.int32())]

    def rows(own: Pieces, texts: list):
        words, sizes = own.known(texts)
        known = own.solved
        stop = np.cumsum(sizes)
        loss = known.loss[words]
        count = known.count[words]
        ids = np.ascontiguousarray(own.gathered(known.at[words], count), "<u4")
        edge = np.concatenate([[0], np.cumsum(count)])
        for i, (a, b) in enumerate(zip((stop - sizes).tolist(), stop.tolist(), strict=True)):
            first = ids[edge[a] : edge[b]]
            best = float(known.best[words[a:b]].sum())
            second, other = None, None
            k = a + int(loss[a:b].argmin()) if b > a else 0
            if b > a and loss[k] < np.inf:
                w = words[k]
                changed = known.ids[known.at2[w] : known.at2[w] + known.count2[w]]
                other = np.concatenate([ids[edge[a] : edge[k]], changed, ids[edge[k + 1] : edge[b]]]).astype("<u4")
                second = best - float(loss[k])
            exact = bool(known.exact[words[a:b]].all())
            if not exact:
                text = own.split(own.normalised(texts[i]))
                exact = "".join([known.surface.get(j, w) for j, w in zip(words[a:b].tolist(), text, strict=True)]) == "".join(text)
            row = (len(first), zlib.crc32(first.tobytes()), best, second, None if other is None else zlib.crc32(other.tobytes()), exact)
            yield row + ((first.tolist(), None if other is None else other.tolist()) if with_ids else ())

    def run(batches):
        own = Pieces.of(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = part.column(n).to_pylist()
                for a, b in common.blocks(texts, TEXT):
                    added = [pa.array(c, k) for c, k in zip(zip(*rows(own, texts[a:b]), strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns[:n], *added], names=[*keep, *names])

    return source.mapInArrow(common.lean(run), schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best and second best segmentation."""
    return encode(common.table(spark, sf_dir, "documents"), model_path())
