"""Packing tokenised documents into sequences: exact complements first, best fit for what is left.

The plan works on the counts of piece lengths, which are at most as many as a sequence has tokens, so it is the
same small job for any input. Lengths are taken from the longest down. What one or several pieces of a length leave of
their sequence is a gap, and an index of single, pair and triple sums tells which lengths fill it exactly; a
combination is used as often as the counts allow. Lengths without such a complement go on to best fit.
Pieces find their places by their rank within their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import common

LENGTH = 2048
PARTS_KEPT = 400_000  # parts of words whose ids a task remembers; it starts anew beyond that
BLOCK = 4_000_000  # characters that are tokenised at once
SPARED = (0, 1 / 32, 1 / 8, 1 / 2)  # shares of the tokens that the exact phase may leave to best fit
WORD_END = "</w>"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may begin a piece with letters after it

#: The steps of a tokenizer whose texts may be cut at white space.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Ids:
    """Token ids of texts, each followed by id 0, as little-endian unsigned 32-bit bytes.

    Texts are cut at spaces, tabs and line ends and each distinct word is tokenised once; of words with marks
    at their end, letters and marks apart. Both only if the file's own steps, which are looked up when it is loaded,
    never reach across such a cut; texts of any other tokenizer are tokenised whole.
    """

    _loaded: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        own = json.loads(self.tokenizer.to_str())
        steps, split = own["normalizer"] or {}, (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cut = (
            steps.get("type") == "Sequence" and steps["normalizers"] == NORMALIZER
            and [x.get("type") for x in split] == ["Split", "ByteLevel"] and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
            and own["model"].get("end_of_word_suffix") == WORD_END and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
            and all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not any(c.isspace() for c in x["content"]) for x in own["added_tokens"])
        )
        self.between = next(((x["content"], x["id"]) for x in own["added_tokens"] if x["special"] and "<|" in x["content"]), None)
        self.cut = self.cut and self.between is not None
        letters = "".join(c for c in map(chr, range(0x61, 0x250)) if self._apart(c))
        self.ends = re.compile(f"([{letters}]*)([{re.escape(MARKS)}]*)") if letters else None
        self.cut = self.cut and self.ends is not None
        names = self.tokenizer.get_vocab() if self.cut else {}
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)  # which ids end a word
        self.last[[i for name, i in names.items() if name.endswith(WORD_END)]] = True

    def _apart(self, letter: str) -> bool:
        """Whether the tokenizer keeps a letter one letter and cuts between it and a mark."""
        own = self.tokenizer.normalizer.normalize_str(letter) if self.cut else ""
        return len(own) == 1 and own.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(own + "!")) == 2 and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(own + "a")) == 1

    @classmethod
    def forget(cls) -> None:
        for own in cls._loaded.values():
            own.parts = {}

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def folded(text: str) -> str:
        """A-Z as a-z where that changes no step: not near special tokens, nor where a lower letter composes with a mark."""
        if "<|" in text:
            return text
        if text.isascii():
            return text.lower()
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text

    def _joined(self, parts: list[str], between: str, last: np.ndarray | int) -> list[bytes] | None:
        """The ids of parts that are tokenised as one text, ``between`` standing between them.

        ``last`` tells where a part ends: by the ids that end a word, or by the id that stands between. None if there are
        not as many ends as parts.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(parts)], add_special_tokens=False)[0].ids, "<u4")
        if isinstance(last, int):
            ends = np.append(np.flatnonzero(ids == last), len(ids))
            starts = np.append(0, ends[:-1] + 1)
        else:
            ends = np.flatnonzero(last[ids]) + 1
            starts = np.append(0, ends[:-1])
        if len(ends) != len(parts):
            return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]

    def _tokenise(self, parts: list[str], simple: bool) -> None:
        """Remember the ids of new parts; ``simple`` ones are letters only or marks only, which stay one word."""
        for s in range(0, len(parts), 20_000):
            some = parts[s : s + 20_000]
            found = self._joined(some, " ", self.last) if simple else self._joined(some, *self.between)
            if found is None:
                found = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.parts.update(zip(some, found, strict=True))

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from those of their parts, which are remembered."""
        find, parts = self.ends.fullmatch, self.parts
        if len(parts) > PARTS_KEPT:
            parts.clear()
        parts[""] = b""
        split = [m.groups() if (m := find(w)) else (w, None) for w in words]
        whole = [w for w, mark in split if mark is None and w not in parts]
        signs = [w for w in whole if "<|" in w]  # these may hold special tokens
        parts.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(signs, self.tokenizer.encode_batch_fast(signs, add_special_tokens=False), strict=True))
        self._tokenise([w for w in whole if "<|" not in w], False)
        self._tokenise(list({p for x in split for p in x if p is not None and p not in parts}), True)
        return [parts[w] + parts[mark] if mark else parts[w] for w, mark in split]

    def encode(self, texts: list) -> list[bytes]:
        if not self.cut:
            return [np.array([*e.ids, 0], "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if not texts:
            return []
        folded = [self.folded(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        split = pc.split_pattern(pa.array(folded, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()  # each distinct word of the texts once
        found = [*self._of_words(words), b"\0\0\0\0"]  # the last one ends a text
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        stored = np.frombuffer(b"".join(found), "<u4")
        ends = np.cumsum(split.value_lengths().to_numpy())
        each = np.insert(coded.indices.to_numpy(), ends, len(words))
        count = size[each]
        stop = np.cumsum(count, dtype=np.int32)  # a block has far fewer ids than that
        raw = stored[np.repeat((np.cumsum(size, dtype=np.int32) - size)[each] - (stop - count), count) + np.arange(stop[-1], dtype=np.int32)].tobytes()
        cuts = [0, *(4 * stop[ends + np.arange(len(ends))].astype(np.int64)).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


common.at_task_end(Ids.forget)


class Sums:
    """The sums of one, two and three available lengths, by sum, while counts in ``have`` only fall.

    The pairs of a sum are listed when it is first asked for, the most even one first, or the most uneven one. What the counts no longer allow never comes back, so the place in a list of pairs, and the length that a triple
    begins with, move on only.
    """

    def __init__(self, have: list[int], even: bool = True):
        self.have, self.even = have, even
        self.pairs: dict[int, list[int]] = {}
        self.place: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def pair(self, total: int, beside: int = 0) -> list[int] | None:
        """Two available lengths of this sum, when one of ``beside`` is taken."""
        have = self.have
        if total not in self.pairs:
            found = [a for a in range((total + 1) // 2, min(total, len(have))) if have[a] and have[total - a]]
            self.pairs[total] = found if self.even else found[::-1]
        entries, first = self.pairs[total], self.place.get(total, 0)
        for at in range(first, len(entries)):
            a = entries[at]
            b = total - a
            need = 1 + (a == b)
            if have[a] < need or have[b] < need:
                if at == first:
                    first = self.place[total] = at + 1
            elif have[a] >= need + (a == beside) and have[b] >= need + (b == beside):
                return [a, b]
        return None

    def fill(self, gap: int) -> list[int] | None:
        if self.have[gap]:
            return [gap]
        found = self.pair(gap)
        c = self.triples.get(gap, gap - 2)
        while not found and c > 0:
            pair = self.pair(gap - c, c) if self.have[c] else None
            found = [c, *pair] if pair else None
            c -= not found
        self.triples[gap] = c
        return found


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) that hold all pieces: exact complements first, then best fit.

    Pairs are taken most even or most uneven first, and a share of the tokens, in the shortest lengths, may be spared for
    best fit. Of these plans the first with the fewest sequences counts; one that meets the sum's bound ends the search.
    """
    total = sum(k * n for k, n in counts.items())
    best, least = [], None
    for spared in SPARED:
        for even in (True, False):
            own = _plan(counts, length, int(total * spared), even)
            size = sum(n for n, _ in own)
            if least is None or size < least:
                best, least = own, size
            if least * length - total < length:
                return best
    return best


def _plan(counts: dict[int, int], length: int, spared: int, even: bool) -> list[tuple[int, tuple[int, ...]]]:
    have, left, out = [0] * (length + 1), {}, []
    for k, n in sorted(counts.items()):
        aside = min(n, spared // k)
        spared -= k * aside
        have[k] = n - aside
        if aside:
            left[k] = aside
    sums = Sums(have, even)
    for top in range(length, 0, -1):
        while have[top]:
            used = None
            for k in range(max(1, -(-(length - 3 * top) // top)), min(have[top], length // top) + 1):
                have[top] -= k
                more = sums.fill(length - k * top) if k * top < length else []
                have[top] += k
                if more is not None:
                    used = [top] * k + more
                    break
            if used is None:
                left[top], have[top] = left.get(top, 0) + have[top], 0
                break
            each = {x: used.count(x) for x in used}
            times = min(have[x] // n for x, n in each.items())
            for x, n in each.items():
                have[x] -= n * times
            out.append((times, tuple(used)))
    return out + best_fit(left, length)


def best_fit(counts: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, the longest first, on counts: sequences with the same lengths in them are one row with their number."""
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            fits = [r for r in rooms if r >= size]
            if not fits:
                each = min(n, length // size)
                times = n // each
                rooms.setdefault(length - each * size, []).append((times, (size,) * each))
                n -= times * each
                continue
            room = min(fits)
            times, used = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // size, max(1, n // times))
            now = min(times, n // each)
            if now < times:
                rooms.setdefault(room, []).append((times - now, used))
            rooms.setdefault(room - each * size, []).append((now, used + (size,) * each))
            n -= now * each
    return [row for rows in rooms.values() for row in rows]


def pieces(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Every document's pieces with their ids' crc32, and their rank among pieces of that length of the task."""
    source = documents.select("doc_id", F.col("text").alias("_packed"))

    def run(batches):
        ids = Ids.of(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in common.blocks(texts, BLOCK):
                at, rows = [], []
                for i, x in enumerate(ids.encode(texts[a:b])):
                    n = len(x) // 4
                    for k, s in enumerate(range(0, n, length)):
                        m = min(length, n - s)
                        at.append(a + i)
                        rows.append((k, s, m, zlib.crc32(x[4 * s : 4 * (s + m)]), task, seen[m]))
                        seen[m] += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), columns[0].cast(pa.int32()), *columns[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return source.mapInArrow(common.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long")


def pack(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """All documents as pieces with their sequence and their offset there.

    Null text counts as empty: one piece with id 0 alone. Rows that repeat a document are packed as often as
    they occur. The pieces are written once; of the counts only sums by length reach the driver, and the plan
    that comes back has a few rows for each length.
    """
    spark = documents.sparkSession
    own = common.written(pieces(documents, path, length), "pieces")
    counts = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, first = [], 0
    taken: dict[int, int] = {}
    for times, used in plan(totals, length):
        at = 0
        for m in used:
            rows.append((m, taken.get(m, 0), first, at))
            taken[m] = taken.get(m, 0) + times
            at += m
        first += times
    rows.sort()
    of = np.array([r[0] * (1 << 48) + r[1] for r in rows], np.int64)  # length and first rank, in one sorted key
    where = np.array([(r[1], r[2], r[3]) for r in rows], np.int64).reshape(-1, 3)
    shipped = spark.sparkContext.broadcast((of, where))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def run(batches):
        of, where = shipped.value
        for batch in batches:
            m = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(of, m * (1 << 48) + rank, "right") - 1
            found = where[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 1] + rank - found[:, 0]), pa.array(found[:, 2])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = own.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(common.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
