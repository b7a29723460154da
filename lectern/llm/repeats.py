"""Exact removal of passages that occur earlier in the corpus, by prefix-free parsing.

A rolling hash over 32 bytes triggers at the least hash of every 100-byte string, so equal strings have their
trigger at the same place. Consecutive strings with one trigger form a phrase; a text is the sequence of its
phrases (the parse) over the distinct phrases (the dictionary). Phrases overlap by more than a trigger and
none is a prefix of another, so equal strings always lie at equal places of phrases with one trigger.

The parse is put in the order of (trigger, phrase, document, place) by one distributed sort: that brings all
occurrences of equal phrases together, earliest first. A phrase whose trigger has no other phrase is decided as a
whole. Where one trigger has several phrases, the suffix array of these phrases, the trigger's part of the dictionary,
puts their suffixes in the order of their first 100 bytes; equal ones are neighbours, and with the phrases' places in the
parse they come in corpus order, of which all but the first repeat. Triggers and phrases are told apart by fingerprints;
no order between suffixes of different triggers is needed, as they are never equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

LENGTH = 100  # bytes of a string
TRIGGER = 32  # bytes of the rolling hash
STARTS = LENGTH - TRIGGER + 1  # triggers in a string
BLOCK = 1 << 18  # bytes that are parsed at once
LONGEST = 1 << 22  # longer texts are parsed in parts of so many strings
GROUP = 8192  # phrases of one trigger that one task puts in order
SORTED = 1 << 18  # bytes of phrases whose suffixes are put in order at once
PHRASE, MARK, DETAIL = 0, 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as far as a task needs them."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def forget(cls) -> None:
        cls.up = cls.down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 19)
            ones = np.full(size, _BASE)
            ones[0] = 1
            cls.up = np.cumprod(ones)
            ones = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            ones[0] = 1
            cls.down = np.cumprod(ones)
        return cls.up, cls.down


common.at_task_end(_Powers.forget)


class Hashes:
    """Fingerprints of any substring of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _Powers.of(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODE[raw] * self.up[: len(raw)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` consecutive values."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def parse(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of some texts: text number, first string's start, number of strings, trigger and phrase fingerprints."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size)
    if len(raw) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    hashes = Hashes(raw)
    t, n = hashes.total, len(raw) - TRIGGER + 1
    key = (_mix((t[TRIGGER:] - t[:n]) * hashes.down[:n]) & ~_POS) | np.arange(n, dtype=np.uint64)
    owner = (_least(key, STARTS) & _POS).astype(np.int64)  # the leftmost least trigger of each string
    text = np.repeat(np.arange(len(parts)), size)[: len(owner)]
    inside = np.arange(len(owner)) + LENGTH <= end[text]
    at = np.flatnonzero(inside)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    own, of = owner[at], text[at]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])))
    start, count = at[new], np.diff(np.append(new, len(at)))
    trigger = hashes.of(own[new], own[new] + TRIGGER)
    phrase = hashes.of(start, start + count + LENGTH - 1)
    return of[new], start - (end - size)[of[new]], count, trigger.astype(np.int64), phrase.astype(np.int64)


def suffix_ranks(raw: np.ndarray) -> np.ndarray:
    """The rank, in the order of their first LENGTH bytes, of the suffixes that have so many; equal beginnings share a rank.

    Ranks of eight bytes are their number; pairs of ranks give those of twice the length, and two of 64 bytes that
    overlap those of 100.
    """
    x = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        x |= raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank = np.unique(x, return_inverse=True)[1]
    size = 8
    while size < LENGTH:
        step = min(size, LENGTH - size)
        rank = np.unique((rank[:-step] << 32) | rank[step:], return_inverse=True)[1]
        size += step
    return rank


def _later(a, b, doc, start):
    """Rows in the order of (a, b, doc, start), and which of them repeat an earlier place's (a, b)."""
    order = np.lexsort((start, doc, b, a))
    a, b, doc, start = a[order], b[order], doc[order], start[order]
    same = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(a)))) if len(a) else np.zeros(0, np.int64)
    return order, same & ~((doc == doc[first]) & (start == start[first])), same


FIELDS = "kind int, a long, b long, doc_id long, start long, count int"


def _rows(kind, a, b, doc, start, count) -> pa.RecordBatch:
    n = len(a)
    kinds = pa.array(np.full(n, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32))
    return pa.RecordBatch.from_arrays([kinds, pa.array(a), pa.array(b), pa.array(doc), pa.array(start), pa.array(np.asarray(count, np.int32))], names=["kind", "a", "b", "doc_id", "start", "count"])


def _local(a, b, doc, start, count, kind=PHRASE):
    """Within a batch, only the first place of equal ones goes on; later ones are marks already."""
    order, later, same = _later(a, b, doc, start)
    go = order[~same]
    yield _rows(kind, a[go], b[go], doc[go], start[go], count[go])
    out = order[later]
    if len(out):  # dealt anywhere
        doc, start, count = _joined(doc[out], start[out], count[out])
        spread = _mix(doc.astype(np.uint64) * _BASE + start.astype(np.uint64)).astype(np.int64)
        yield _rows(MARK, spread, np.zeros(len(doc), np.int64), doc, start, count)


def _joined(doc, start, count):
    """Runs of strings that touch or overlap, as one run each."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + count)[order]
    new = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40)
    cut = np.append(True, new[1:] | (start[1:] > reach[:-1]))
    at = np.flatnonzero(cut)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - start[at]


def _phrases(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            found: list = []
            group: list[bytes] = []
            of: list[tuple[int, int]] = []

            def flush(ids=ids, found=found, group=group, of=of):
                if group:
                    text, start, *rest = parse(group)
                    row, base = np.array(of, np.int64).T
                    found.append((ids[row[text]], start + base[text], *rest))
                    group.clear()
                    of.clear()

            total = 0
            for i, value in enumerate(batch.column(1)):
                data = value.as_py().encode("utf-8", "surrogatepass")
                for s in range(0, max(1, len(data) - LENGTH + 1), LONGEST):
                    part = data if len(data) <= LONGEST else data[s : s + LONGEST + LENGTH - 1]
                    group.append(part)
                    of.append((i, s))
                    total += len(part)
                    if total > BLOCK:
                        flush()
                        total = 0
            flush()
            if found:
                doc, start, count, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from _local(a, b, doc, start, count)

    return documents.mapInArrow(common.lean(run), FIELDS)


def _decide(rows: DataFrame, detail: bool) -> DataFrame:
    """Marks for all but the first place of equal (a, b); with ``detail`` also the first places of each phrase
    whose trigger has several. A stream over sorted rows: nothing is held but the last one's state."""

    def run(batches):
        state = None  # trigger, phrase, first place of that phrase, row of the trigger's first phrase if not passed on
        for batch in batches:
            columns = [np.array(c) for c in batch.columns]
            kind = columns[0]
            m = kind == MARK
            if m.any():
                yield _rows(MARK, *(c[m] for c in columns[1:]))
            a, b, doc, start, count = (c[~m] for c in columns[1:])
            n = len(a)
            if not n:
                continue
            go_on = state is not None and state[0] == a[0]
            same_a = np.append(go_on, a[1:] == a[:-1])
            same_b = same_a & np.append(go_on and state[1] == b[0], b[1:] == b[:-1])
            first = np.maximum.accumulate(np.where(same_b, -1, np.arange(n)))
            known = first >= 0
            first_doc = np.where(known, doc[first], state[2][0] if state else 0)
            first_start = np.where(known, start[first], state[2][1] if state else 0)
            later = same_b & ~((doc == first_doc) & (start == first_start))
            if later.any():
                yield _rows(MARK, a[later], b[later], doc[later], start[later], count[later])
            waiting = None
            if detail:
                group = np.cumsum(~same_a) - (0 if go_on else 1)
                kinds = np.bincount(group, ~same_b, minlength=group[-1] + 1)
                if go_on:
                    kinds[0] += 1
                several = kinds > 1
                if go_on and state[3] is None:
                    several[0] = True
                if go_on and several[0] and state[3] is not None:
                    yield _rows(DETAIL, *(np.array([x]) for x in state[3]))
                out = ~same_b & several[group]
                if out.any():
                    yield _rows(DETAIL, a[out], b[out], doc[out], start[out], count[out])
                if not several[-1]:
                    i = np.flatnonzero(group == group[-1])
                    i = i[~same_b[i]]
                    waiting = tuple(c[i[0]] for c in (a, b, doc, start, count)) if len(i) else state[3]
            state = (a[-1], b[-1], (first_doc[-1], first_start[-1]), waiting)

    sorted_rows = rows.repartition("a") if detail else rows.repartition("a", "b")
    return sorted_rows.sortWithinPartitions("a", "b", "doc_id", "start").mapInArrow(common.lean(run), FIELDS)


def _contexts(detail: DataFrame, texts: DataFrame) -> DataFrame:
    """(trigger, doc_id, start, bytes) of phrases that share their trigger with others."""
    asked = detail.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "a")).alias("asked"))  # at most the text's phrases
    source = texts.join(asked, "doc_id").select("doc_id", "text", F.col("asked.start").alias("s"), F.col("asked.count").alias("c"), F.col("asked.a").alias("a"))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, value, s, c, a in zip(*(batch.column(k) for k in range(5)), strict=True):
                data, doc = value.as_py().encode("utf-8", "surrogatepass"), doc.as_py()
                rows += [(t, doc, x, data[x : x + y + LENGTH - 1]) for t, x, y in zip(a.as_py(), s.as_py(), c.as_py(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "doc_id", "start", "bytes"])

    return source.mapInArrow(common.lean(run), "a long, doc_id long, start long, bytes binary")


def _resolve(contexts: DataFrame) -> DataFrame:
    """Marks for strings that repeat among the phrases of one trigger.

    Groups are compared in blocks. Those of more than GROUP phrases go on as single strings, to be dealt by
    their own fingerprints.
    """

    def places(size):
        """Of all strings of phrases of these sizes: the phrase, the place in it and in the phrases' joined bytes."""
        count = size - LENGTH + 1
        of = np.repeat(np.arange(len(size)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, step, np.repeat(np.cumsum(size) - size, count) + step

    def finish(rows):
        size = np.array([len(x) for x in rows[3]], np.int64)
        ends = np.flatnonzero(np.append(rows[0][1:] != rows[0][:-1], True)) + 1
        start, done = 0, 0
        for end, total in zip(ends.tolist(), np.cumsum(size)[ends - 1].tolist(), strict=True):
            if total - done >= SORTED or end == len(size):  # whole triggers, together of about so many bytes
                yield from ordered([x[start:end] for x in rows], size[start:end])
                start, done = end, total

    def ordered(rows, size):
        a, doc, start, data = rows
        of, step, at = places(size)
        rank = suffix_ranks(np.frombuffer(b"".join(data), np.uint8))[at]
        order, later, _ = _later(a[of], rank, doc[of], start[of] + step)
        out = order[later]
        if len(out):
            doc, start, count = _joined(doc[of[out]], start[of[out]] + step[out], np.ones(len(out), np.int64))
            yield _rows(MARK, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), doc, start, count)

    def spill(rows):
        for s in range(0, len(rows[0]), GROUP):
            a, doc, start, data = (x[s : s + GROUP] for x in rows)
            of, step, at = places(np.array([len(x) for x in data], np.int64))
            b = Hashes(np.frombuffer(b"".join(data), np.uint8)).of(at, at + LENGTH).astype(np.int64)
            yield from _local(a[of], b, doc[of], start[of] + step, np.ones(len(of), np.int64))

    def run(batches):
        kept, large = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, object)], None
        for batch in batches:
            new = [np.array(batch.column(k)) for k in range(3)] + [np.array(batch.column(3).to_pylist(), object)]
            rows = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if not len(rows[0]):
                continue
            if large is not None:
                n = int(np.searchsorted(rows[0] != large, True)) if (rows[0] != large).any() else len(rows[0])
                yield from spill([x[:n] for x in rows])
                rows = [x[n:] for x in rows]
                if not len(rows[0]):
                    kept = rows
                    continue
                large = None
            last = rows[0] == rows[0][-1]
            cut = len(last) - int(last.sum())
            for s in range(0, cut, 4 * GROUP):  # whole groups of up to a batch at a time
                yield from _blocks([x[:cut] for x in rows], s, finish, spill)
            kept = [x[cut:] for x in rows]
            if len(kept[0]) > GROUP:
                large = kept[0][0]
                yield from spill(kept)
                kept = [x[:0] for x in kept]
        if len(kept[0]):
            yield from finish(kept)

    return contexts.repartition("a").sortWithinPartitions("a", "doc_id", "start").mapInArrow(common.lean(run), FIELDS)


def _blocks(rows, s, finish, spill):
    """The groups that begin among the rows from ``s`` on, within one block."""
    a = rows[0]
    start = s if s == 0 else s + int(np.argmax(np.append(a[s:] != a[s - 1], True)))
    end = min(s + 4 * GROUP, len(a))
    if start >= end:
        return
    stop = end + (int(np.argmax(np.append(a[end:] != a[end - 1], True))) if end < len(a) else 0)
    own = [x[start:stop] for x in rows]
    cut = np.flatnonzero(np.append(True, own[0][1:] != own[0][:-1]))
    size = np.diff(np.append(cut, len(own[0])))
    small = np.repeat(size <= GROUP, size)
    if small.any():
        yield from finish([x[small] for x in own])
    if not small.all():
        yield from spill([x[~small] for x in own])


def repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, start, count) runs: the 100-byte strings that start at start .. start + count - 1 occur earlier.

    Null ids and texts have none. A string is not earlier than one at the same start of a row with its id.
    """
    usable = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    parsed = common.written(_decide(_phrases(usable), True), "phrases")
    within = _resolve(_contexts(parsed.where(F.col("kind") == DETAIL), usable))
    within = common.written(within, "strings")
    rest = _decide(within.where(F.col("kind") == PHRASE), False)
    return parsed.where(F.col("kind") == MARK).union(within.where(F.col("kind") == MARK)).union(rest).select("doc_id", "start", "count")


def kept(data: bytes, start: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes that no repeated string covers, and the (start, stop) of the maximal removed runs."""
    if not len(start):
        return data, np.zeros((0, 2), np.int64)
    _, s, c = _joined(np.zeros(len(start), np.int64), start, count + LENGTH - 1)
    spans = np.stack([s, s + c], 1)
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)), spans


def _with_runs(documents: DataFrame) -> DataFrame:
    runs = repeated(documents).groupBy("doc_id").agg(F.collect_list("start").alias("_starts"), F.collect_list("count").alias("_counts"))
    known = documents.where(F.col("doc_id").isNotNull()).join(runs, "doc_id", "left")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("_starts",)] + [F.lit(None).cast("array<int>").alias("_counts")]
    return known.unionByName(documents.where(F.col("doc_id").isNull()).select("*", *none))


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; null text counts as empty."""
    source = _with_runs(documents.select("doc_id", "text")).select("doc_id", "text", "_starts", "_counts")

    def run(batches):
        for batch in batches:
            rows = []
            for text, s, c in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                left, spans = kept(data, np.array(s.values), np.array(c.values, np.int64)) if s.is_valid else (data, ())
                rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return source.mapInArrow(common.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text`` and n_chars counted anew.

    Characters of which only some bytes are covered go as well. Null texts stay null.
    """
    columns = documents.columns
    source = _with_runs(documents).select(*columns, "_starts", "_counts")
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in batches:
            texts, lengths = [], []
            for text, s, c in zip(batch.column(at), batch.column(len(columns)), batch.column(len(columns) + 1), strict=True):
                text = text.as_py()
                if s.is_valid and text is not None:
                    text = kept(text.encode("utf-8", "surrogatepass"), np.array(s.values), np.array(c.values, np.int64))[0].decode("utf-8", "ignore")
                texts.append(text)
                lengths.append(None if text is None else len(text))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            if chars is not None:
                out[chars] = pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return source.mapInArrow(common.lean(run), documents.schema)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    return removed(common.table(spark, sf_dir, "documents"))
