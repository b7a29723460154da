"""Fuzzy matching of heard words with a text, anchors, interpolation and the decisions that follow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import timeline


def best_match(openings: DataFrame, heard: DataFrame, opening: str = "words", said: str = "heard") -> DataFrame:
    """For each heard item (item_id) the opening (key) with the largest share of its distinct words heard; the
    smallest key on ties; ('?', 0) is a null key here.

    Openings and items meet through an inverted index on words. Items without any word in common get null.
    """
    a = openings.select("key", F.size(F.array_distinct(opening)).alias("_n"), F.explode(F.array_distinct(opening)).alias("_w"))
    b = heard.select("item_id", F.explode(F.array_distinct(said)).alias("_w"))
    hits = a.join(b, "_w").groupBy("item_id", "key").agg((F.count("*") / F.first("_n")).alias("score"))
    best = hits.groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("_b"))
    return heard.select("item_id").join(best, "item_id", "left").select("item_id", F.col("_b.key").alias("key"), F.coalesce(-F.col("_b.s"), F.lit(0.0)).alias("score"))


def forward_match(tokens: DataFrame, heard: DataFrame, by: list[str], reach: int = 1500, least: int = 40) -> DataFrame:
    """Where the heard words continue in the text after a cursor: (item, best_off, best_score).

    A span of 1.3 times the heard words slides over the alignable tokens from ``least`` to ``reach`` words ahead,
    as long as half of it is filled; its score is the share of its distinct words that were heard, the first
    best one wins, none gives offset 0. Each token is joined to the heard words once; a span's score is a
    difference of running sums, where a word counts at its first place in the span.
    """
    n = F.size("heard")
    asked = heard.withColumn("_span", F.greatest(F.lit(1), F.floor(n * 13 / 10))).withColumn("_set", F.array_distinct("heard"))
    text = tokens.where(F.col("apos").isNotNull()).select(*by, "apos", "nw")
    first = F.floor(F.col("cursor") / reach)
    asked = asked.withColumn("_bin", F.explode(F.array(first, first + 1)))
    own = asked.join(text.withColumn("_bin", F.floor(F.col("apos") / reach)), [*by, "_bin"]).where((F.col("apos") >= F.col("cursor")) & (F.col("apos") < F.col("cursor") + reach))
    keys = [*by, "item"]
    own = own.select(*keys, "_span", (F.col("apos") - F.col("cursor")).alias("_o"), "nw", F.array_contains("_set", F.col("nw")).alias("_hit"))
    # token o counts in the spans that start after its previous place and at most span - 1 before o
    prior = F.lag("_o").over(Window.partitionBy(*keys, "nw").orderBy("_o"))
    own = own.withColumn("_first", F.greatest(F.coalesce(prior + 1, F.lit(0)), F.col("_o") - F.col("_span") + 1, F.lit(0)))
    steps = own.select(*keys, "_span", F.explode(F.array(F.struct(F.col("_first").alias("o"), F.lit(1).alias("d"), F.col("_hit").cast("int").alias("h")), F.struct((F.col("_o") + 1).alias("o"), F.lit(-1).alias("d"), (-F.col("_hit").cast("int")).alias("h")))).alias("_e"))
    ends = own.groupBy(*keys).agg(F.count("*").alias("_size"))
    change = steps.groupBy(*keys, "_span", F.col("_e.o").alias("off")).agg(F.sum("_e.d").alias("d"), F.sum("_e.h").alias("h"))
    run = Window.partitionBy(*keys).orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = change.withColumn("_d", F.sum("d").over(run)).withColumn("_h", F.sum("h").over(run))
    # between two changes the score is level, so its first offset stands for all; ``least`` may cut into a level
    level = level.withColumn("_next", F.lead("off").over(Window.partitionBy(*keys).orderBy("off"))).join(ends, keys)
    level = level.withColumn("off", F.greatest("off", F.lit(least))).where((F.col("off") < F.coalesce("_next", F.col("_size"))) & (F.col("off") <= F.col("_size") - F.greatest(F.lit(1), F.floor(F.col("_span") / 2))))
    best = level.where("_h > 0").groupBy(*keys).agg(F.min(F.struct((-(F.col("_h") / F.col("_d"))).alias("s"), "off")).alias("_b"))
    return heard.join(best, keys, "left").select(*keys, F.coalesce(F.col("_b.off"), F.lit(0)).cast("long").alias("best_off"), F.coalesce(-F.col("_b.s"), F.lit(0.0)).alias("best_score"))


MOST_BLOCKS = 512  # of 64 items, that are broadcast


def in_blocks(items: DataFrame, size: int = 64) -> tuple[DataFrame, int]:
    """Items dealt to blocks ``_b`` of about ``size``, and the number of blocks."""
    n = max(1, -(-items.count() // size))
    return items.withColumn("_b", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")), n


def _blocks_of(items: list[dict]) -> tuple:
    """A block of items as numbers: (items, spans, words, the items of each word as offsets and places)."""
    sets = [list(dict.fromkeys(x["heard"] or [])) for x in items]
    spans = np.array([max(1, len(x["heard"] or []) * 13 // 10) for x in items], np.int64)
    places: dict[str, list[int]] = {}
    for k, own in enumerate(sets):
        for w in own:
            places.setdefault(w, []).append(k)
    start = np.cumsum([0, *(len(x) for x in places.values())])
    flat = np.array([k for x in places.values() for k in x], np.int64)
    return [x["item"] for x in items], spans, pa.array(list(places), pa.string()), start, flat


def _best_spans(prev: np.ndarray, word: np.ndarray, spans: np.ndarray, start: np.ndarray, flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best offset and score of each item in one window: ``prev`` is each token's previous place, ``word`` its
    number among the items' words or -1."""
    m, k = len(prev), len(spans)
    own, at = np.unique(spans, return_inverse=True)
    o = np.arange(m)
    if m <= least:
        return np.zeros(k, np.int64), np.zeros(k)
    distinct = np.stack([np.cumsum(np.bincount(np.maximum(prev + 1, o - n + 1).clip(0), minlength=m)) - o for n in own])
    token = np.flatnonzero(word >= 0)
    count = start[word[token] + 1] - start[word[token]]
    item = flat[np.repeat(start[word[token]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    token = np.repeat(token, count)
    row = item * (m + 1)
    first = np.maximum(prev[token] + 1, token - spans[item] + 1).clip(0)
    change = np.bincount(row + first, minlength=k * (m + 1)) - np.bincount(row + token + 1, minlength=k * (m + 1))
    score = np.cumsum(change.reshape(k, m + 1), 1)[:, :m] / distinct[at]
    score[(o < least) | (o > (m - np.maximum(1, spans // 2))[:, None])] = 0.0
    best = score.argmax(1)
    top = score[np.arange(k), best]
    return np.where(top > 0, best, 0), top


def forward_match_all(texts: DataFrame, books: DataFrame, items: DataFrame, by: list[str], stride: int = 1000, reach: int = 1500, least: int = 40) -> DataFrame:
    """``forward_match`` of every item (item, a number, and heard) in every book, from each ``stride``-th word on:
    (item, cursor, best_off, best_score).

    texts: the alignable words of each text of a book as an array, and the place ``start`` of its first one; or single
    tokens (apos, nw). The cursors stop where no word lies ``least`` ahead; a book has the cursor 0 at least. Windows overlap, so every
    span of up to reach - stride - least words lies whole in one. Books are cut in stretches of eight windows, which
    meet items in blocks of about 64; a window's scores are sums over the tokens that were heard.
    """
    length, spare = 8 * stride, reach - stride
    if "words" not in texts.columns:  # single tokens: apos and nw
        texts = texts.where(F.col("apos").isNotNull()).select(*by, F.col("apos").alias("start"), F.array("nw").alias("words"))
    n = F.size("words")
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + n - 1) / length)
    own = texts.where(n > 0).withColumn("_j", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last).cast("array<long>")))
    a, b = F.greatest("start", F.col("_j") * length), F.least(F.col("start") + n, (F.col("_j") + 1) * length + spare)
    own = own.where(b > a).select(*by, "_j", a.alias("_at"), F.slice("words", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("_part"))
    own = own.groupBy(*by, "_j").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"])).alias("_words"))
    own = books.select(*by).join(own, by, "left").withColumn("_j", F.coalesce("_j", F.lit(0).cast("long")))
    # a stretch is few bytes and much work, so it is dealt by number and not by size
    own = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_j")
    dealt, n = in_blocks(items)
    blocks = dealt.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("item", "heard"))).alias("_items"))
    blocks = F.broadcast(blocks) if n <= MOST_BLOCKS else blocks
    own = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "_b").select(*by, "_j", "_words", "_b", "_items")
    kinds = [(c, books.schema[c].dataType) for c in by] + [("item", items.schema["item"].dataType)]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds) + ", cursor long, best_off long, best_score double"

    def run(batches):
        known: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                j, b = part.column(len(by))[0].as_py(), part.column(len(by) + 2)[0].as_py()
                if b not in known:
                    known = {b: _blocks_of(part.column(len(by) + 3)[0].as_py())} | dict([*known.items()][:15])
                names, spans, vocabulary, start, flat = known[b]
                words = part.column(len(by) + 1)[0].values
                coded = (pa.array([], pa.string()) if words is None else words.cast(pa.string())).dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                word = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
                order = np.argsort(ids, kind="stable")
                prev = np.full(len(ids), -1, np.int64)
                same = ids[order][1:] == ids[order][:-1]
                prev[order[1:][same]] = order[:-1][same]
                cursors, found = [], []
                for a in range(0, length, stride):
                    if len(ids) - a > least or (j == 0 and a == 0):
                        cursors.append(j * length + a)
                        found.append(_best_spans(prev[a : a + reach] - a, word[a : a + reach], spans, start, flat, least))
                if not found:
                    continue
                n = len(cursors) * len(names)
                keys = [part.column(c).take(pa.array(np.zeros(n, np.int64))) for c in range(len(by))]
                added = [pa.array(names * len(cursors), batch.schema.field(len(by) + 3).type.value_type.field(0).type), pa.array(np.repeat(cursors, len(names))), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))]
                yield pa.RecordBatch.from_arrays([*keys, *added], names=[*by, "item", "cursor", "best_off", "best_score"])

    return own.mapInArrow(run, schema)


def resync_decision(here: Column, off: Column, score: Column, force: Column, resync_min: float = 0.5, match_min: float = 0.6, least: int = 40) -> Column:
    """ok, cut or deadzone, from the overlap here and the forward match."""
    ok = here >= resync_min
    return F.when(ok & ~force, "ok").when((score >= match_min) & (off >= least), "cut").when(ok, "ok").otherwise("deadzone")


def deadzone_runs(decisions: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """Runs of successive deadzone decisions and whether one is long enough to give up."""
    order = Window.partitionBy(*by).orderBy("step")
    own = decisions.withColumn("_n", F.row_number().over(order)).where(F.col("decision") == "deadzone")
    own = own.withColumn("_g", F.col("_n") - F.row_number().over(order))
    return own.groupBy(*by, "_g").agg(F.min("step").alias("step"), F.count("*").alias("length")).drop("_g").withColumn("abort", F.col("length") >= most)


def mark_cuts(tokens: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Tokens whose alignable place lies in a cut span [a0, a1) get status CUT. Spans of one text don't overlap."""
    own = timeline.range_assign(tokens.where("apos is not null"), cuts, by, "apos", "a0", ["a0", "a1"])
    hit = own.where(F.col("apos") < F.col("a1")).select(*by, "pos", F.lit(True).alias("_cut"))
    return tokens.join(hit, [*by, "pos"], "left").withColumn("status", F.when(F.col("_cut"), "CUT").otherwise(F.col("status"))).drop("_cut")


def rolled_back(cuts: DataFrame) -> DataFrame:
    """Cut spans as they stand after checks: a wrong one (``wrong``) covers all up to the cursor and leaves the log."""
    return cuts.withColumn("a1", F.when(F.col("wrong"), F.greatest("a1", "cursor")).otherwise(F.col("a1"))).withColumn("logged", ~F.col("wrong"))


def here_words(words: DataFrame, windows: DataFrame, by: list[str], width: int) -> DataFrame:
    """The normal forms of aligned words that touch a window, in order, as one text. Pending and cut words don't count."""
    own = words.where((F.col("status") == "ALIGNED") & (F.col("nw") != "")).select(*by, "pos", "nw", "s_ms", "e_ms")
    both = timeline.interval_join(windows, own, by, ("t0", "t1"), ("s_ms", "e_ms"), width, closed=True)
    found = both.groupBy(*by, "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nw"))), lambda x: x["nw"]), " ").alias("here"))
    return windows.join(found, [*by, "i"], "left").withColumn("here", F.coalesce("here", F.lit("")))


def locate(segments: DataFrame, heard: DataFrame, by: list[str], size: int = 60, margin: int = 3000) -> DataFrame:
    """The segment where the first ``size`` heard words lie best: (item, seg, score).

    A window is the whole segments from one on until they hold ``size`` words. Its score is the share of the
    distinct target words in it; only segments within ``margin`` of the estimate are tried, the first best one
    wins, and without any hit the first of the range. Segments enter through an index on target words, and scores are
    running sums over two events a hit, so no window is ever built.
    """
    own = segments.select(*by, "seg", "words").withColumn("_n", F.size("words").cast("long"))
    own = timeline.cumulative(own, by, "seg", "_n", "_c0")
    # the first window that reaches a segment starts where less than ``size`` words lie between
    reach = Window.partitionBy(*by).orderBy("_c0").rangeBetween(1 - size, Window.currentRow)
    own = own.withColumn("_s0", F.min("seg").over(reach))
    total = own.groupBy(*by).agg((F.max("seg") + 1).alias("_total"))
    asked = heard.select(*by, "item", "est", F.array_distinct(F.slice("heard", 1, size)).alias("_t")).where(F.size("_t") > 0).join(total, by)
    asked = asked.withColumn("_lo", F.greatest(F.lit(0), F.col("est") - margin)).withColumn("_hi", F.least("_total", F.col("est") + margin))
    target = asked.select(*by, "item", "_lo", "_hi", F.size("_t").alias("_k"), F.explode("_t").alias("_w"))
    index = own.where("_n > 0").select(*by, "seg", "_s0", F.explode(F.array_distinct("words")).alias("_w"))
    # a word counts once in the windows that start at the segments from _from to seg, those of its last place left out
    hits = target.join(index, [*by, "_w"]).where((F.col("seg") >= F.col("_lo")) & (F.col("_s0") < F.col("_hi")))
    prior = F.lag("seg").over(Window.partitionBy(*by, "item", "_w").orderBy("seg"))
    hits = hits.withColumn("_from", F.greatest("_s0", "_lo", F.coalesce(prior + 1, F.lit(0)))).withColumn("_to", F.least("seg", F.col("_hi") - 1)).where("_from <= _to")
    steps = hits.select(*by, "item", "_k", F.inline(F.array(F.struct(F.col("_from").alias("seg"), F.lit(1).alias("_d")), F.struct((F.col("_to") + 1).alias("seg"), F.lit(-1).alias("_d")))))
    change = steps.groupBy(*by, "item", "_k", "seg").agg(F.sum("_d").alias("_d"))
    run = Window.partitionBy(*by, "item").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = change.withColumn("_h", F.sum("_d").over(run)).where("_h > 0")  # level up to the next change: its first segment stands for all
    best = scored.groupBy(*by, "item").agg(F.min(F.struct((-(F.col("_h") / F.col("_k"))).alias("s"), "seg")).alias("_b"))
    out = heard.select(*by, "item", "est", F.size("heard").alias("_z")).join(best, [*by, "item"], "left")
    first = F.when(F.col("_z") > 0, F.greatest(F.lit(0), F.col("est") - margin)).otherwise(F.col("est"))
    return out.select(*by, "item", F.coalesce(F.col("_b.seg"), first).alias("seg"), F.coalesce(-F.col("_b.s"), F.lit(0.0)).alias("score"))


def _targets(items: list[dict], size: int) -> tuple:
    """A block of items as numbers: (items, their numbers of distinct target words, words, the items of each word as offsets and places)."""
    own = [{"item": x["item"], "heard": (x["heard"] or [])[:size]} for x in items]
    names, _, vocabulary, start, flat = _blocks_of(own)
    return names, np.array([len(set(x["heard"])) for x in own], np.int64), vocabulary, start, flat


def _words_of_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts of ``normal_lines``: the words before each line (and after the last), all words and their lines."""
    lines = pc.split_pattern(texts, "\n").flatten()
    split = pc.split_pattern(lines, " ")
    words = pc.ascii_trim(split.flatten(), "'")
    line = np.repeat(np.arange(len(lines)), np.diff(split.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(words), 0)
    words, line = words.filter(full), line[full.to_numpy(zero_copy_only=False)]
    return np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(lines)))]), words, line


def _located(before: np.ndarray, word: np.ndarray, line: np.ndarray, lo: int, hi: int, size: int, block: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The first best line of [lo, hi) of each item, and its score. word: numbers of the items' words in order of ``line``, -1 for others.

    A word counts in the windows that start at the lines from one to its own; spans of one word that meet are one span, so
    a frequent word has few of them.
    """
    _, targets, _, start, flat = block
    end = int(np.searchsorted(before[:-1], before[hi - 1] + size, "left"))  # lines that windows from [lo, hi) reach
    n = end - lo
    a, b = np.searchsorted(line, [lo, end])
    w = word[a:b]
    key = np.unique(w[w >= 0].astype(np.int64) * n + (line[a:b][w >= 0] - lo))
    w, at = key // n, key % n
    begun = np.searchsorted(before[lo:end], before[lo:end] - size, "right")[at]
    fresh = np.concatenate([[True], w[1:] != w[:-1]])[: len(w)]
    prior = np.where(fresh, -1, np.concatenate([[-1], at[:-1]])[: len(w)])
    starts = fresh | (begun > prior + 1)
    stops = np.concatenate([starts[1:], [True]])[: len(w)]

    def counts(w: np.ndarray, place: np.ndarray) -> np.ndarray:
        times = start[w + 1] - start[w]
        item = flat[np.repeat(start[w] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        return np.bincount(item * (n + 1) + np.repeat(place, times), minlength=len(targets) * (n + 1))

    change = counts(w[starts], np.maximum(begun, prior + 1)[starts]) - counts(w[stops], at[stops] + 1)
    found = np.cumsum(change.reshape(len(targets), n + 1)[:, : hi - lo], 1, dtype=np.int32)
    best = found.argmax(1)
    return lo + best, found[np.arange(len(targets)), best] / np.maximum(targets, 1)


def locate_all(texts: DataFrame, items: DataFrame, by: list[str], est: int, stride: int | None = None, size: int = 60, margin: int = 3000) -> DataFrame:
    """``locate`` of every item (item, a number, and heard) in every book, around the estimate ``est`` and, with a ``stride``,
    those each stride after it whose range begins in the book: (item, est, seg, score).

    texts: ``lines`` of a text as ``normal_lines`` gives them, and its ``place`` in the book. Texts travel once, as strings. Whole
    books then meet items in blocks, and their windows are counted range by range; no hit of a word is ever a row.
    """
    own = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)  # few bytes, much work: dealt by number
    own = own.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "lines"))), lambda x: x["lines"]).alias("_texts"))
    dealt, n = in_blocks(items.select("item", F.slice("heard", 1, size).alias("heard")), 256)
    blocks = dealt.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("item", "heard"))).alias("_items"))
    blocks = F.broadcast(blocks) if n <= MOST_BLOCKS else blocks
    own = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "_b").select(*by, "_texts", "_b", "_items")
    kinds = [(c, texts.schema[c].dataType) for c in by] + [("item", items.schema["item"].dataType)]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds) + ", est long, seg long, score double"

    def run(batches):
        known: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                b = part.column(len(by) + 1)[0].as_py()
                if b not in known:
                    known = {b: _targets(part.column(len(by) + 2)[0].as_py(), size)} | dict([*known.items()][:15])
                names, targets, vocabulary, _, _ = block = known[b]
                before, words, line = _words_of_lines(part.column(len(by))[0].values)
                word = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                total = len(before) - 1
                ests = range(est, max(total + margin, est + 1), stride) if stride else [est]
                for e in ests:
                    lo, hi = max(0, e - margin), min(total, e + margin)
                    seg, score = _located(before, word, line, lo, hi, size, block) if lo < hi else (np.full(len(names), lo), np.zeros(len(names)))
                    seg = np.where(targets > 0, np.where(score > 0, seg, lo), e)
                    keys = [part.column(c).take(pa.array(np.zeros(len(names), np.int64))) for c in range(len(by))]
                    added = [pa.array(names, batch.schema.field(len(by) + 2).type.value_type.field(0).type), pa.array(np.full(len(names), e, np.int64)), pa.array(seg.astype(np.int64)), pa.array(score.astype(np.float64))]
                    yield pa.RecordBatch.from_arrays([*keys, *added], names=[*by, "item", "est", "seg", "score"])

    return own.mapInArrow(run, schema)


def refine(chunks: DataFrame, openings: DataFrame, by: list[str], window: int, least: float = 0.3) -> DataFrame:
    """The chunk (t) with the best overlap within ``window`` of the estimate; once more within 2.2 windows if that is
    below ``least``, kept only if better. The earliest of equal ones wins."""
    width = max(1, math.ceil(2.2 * window))  # both are dealt to bins, of which an opening looks into three
    bin_ = lambda c: F.floor(F.col(c) / width)
    own = openings.withColumn("_bin", F.explode(F.array(bin_("est") - 1, bin_("est"), bin_("est") + 1)))
    own = own.join(chunks.withColumn("_bin", bin_("t")), [*by, "_bin"]).where(F.abs(F.col("t") - F.col("est")) <= 2.2 * window)
    n = F.size(F.array_distinct("opening"))
    own = own.withColumn("_ov", F.when(n > 0, F.size(F.array_intersect("opening", "heard")) / n).otherwise(F.lit(0.0)))
    key = F.struct((-F.col("_ov")).alias("s"), F.col("t").alias("t"))
    near = F.min(F.when(F.abs(F.col("t") - F.col("est")) <= window, key))
    found = own.groupBy(*by, "chapter", "est").agg(near.alias("_a"), F.min(key).alias("_b"))
    wide = F.col("_a").isNull() | ((-F.col("_a.s") < least) & (F.col("_b.s") < F.col("_a.s")))
    pick = F.when(wide, F.col("_b")).otherwise(F.col("_a"))
    return found.select(*by, "chapter", "est", pick["t"].alias("start"), (-pick["s"]).alias("overlap")).withColumn("low", F.col("overlap") < least)


def trusted_anchors(anchors: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """Anchors of enough confidence whose segment lies after all kept before, in the order of time.

    A dropped one never exceeds the running maximum, so keeping is a comparison with the maximum before.
    """
    before = Window.partitionBy(*by).orderBy("g0", "seg", "conf").rowsBetween(Window.unboundedPreceding, -1)
    own = anchors.where(F.col("conf") >= least)
    return own.withColumn("_m", F.coalesce(F.max("seg").over(before), F.lit(-1))).where(F.col("seg") > F.col("_m")).drop("_m")


def interpolate(anchors: DataFrame, wanted: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The time of segments between anchors, with (0, 0) and the book's ends as bookends: linear between the first
    two anchors around a segment."""
    ends = totals.select(*by, F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("s")).unionByName(totals.select(*by, F.col("total_dur").alias("g"), F.col("total_segs").alias("s")))
    own = anchors.select(*by, F.col("g0").cast("double").alias("g"), F.col("seg").alias("s")).unionByName(ends).distinct()
    order = Window.partitionBy(*by).orderBy("g", "s")
    spans = own.withColumn("_i", F.row_number().over(order)).withColumn("g1", F.lead("g").over(order)).withColumn("s1", F.lead("s").over(order)).where("s1 is not null")
    # segments of spans rise, so the first span around a segment is the first whose end reaches it: an as-of join from above
    tops = Window.partitionBy(*by).orderBy("_i")
    spans = spans.withColumn("_top", F.max("s1").over(tops)).withColumn("_was", F.lag("_top").over(tops)).where(F.col("_was").isNull() | (F.col("_top") > F.col("_was")))
    spans = spans.select(*by, F.coalesce(F.col("_was") + 1, F.lit(-(1 << 62))).alias("_from"), "s", "s1", "g", "g1", "_i")
    both = timeline.range_assign(wanted.select(*by, "seg").distinct(), spans, by, "seg", "_from", ["_from", "s", "s1", "g", "g1"])
    both = both.where(F.col("seg").between(F.col("s"), F.col("s1")))
    at = F.when(F.col("s1") == F.col("s"), F.col("g")).otherwise(F.col("g") + (F.col("g1") - F.col("g")) * (F.col("seg") - F.col("s")) / (F.col("s1") - F.col("s")))
    first = both.select(*by, "seg", at.alias("_t"))
    out = wanted.join(first, [*by, "seg"], "left").join(totals, by)
    return out.select(*wanted.columns, F.coalesce("_t", F.col("total_dur") * F.col("seg") / F.col("total_segs")).alias("time"))


def boundary_gate(chapters: DataFrame, anchors: DataFrame, tracks: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """Whether boundaries can be relied on, with reasons: few_anchors, not_monotonic, low_overlap."""
    order = Window.partitionBy(*by).orderBy("chapter")
    own = chapters.withColumn("_p", F.lag("start").over(order)).groupBy(*by).agg(F.max(F.coalesce(F.col("start") < F.col("_p"), F.lit(False))).alias("_down"), F.count_if(F.col("overlap") < least).alias("n_low"))
    n = anchors.groupBy(*by).agg(F.count("*").alias("n_anchors"))
    need = tracks.groupBy(*by).agg(F.greatest(F.lit(2), F.floor((F.count("*") + 1) / 2)).cast("long").alias("need"))
    own = own.join(n, by, "left").join(need, by).withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    reasons = F.array(F.when(F.col("n_anchors") < F.col("need"), "few_anchors"), F.when(F.col("_down"), "not_monotonic"), F.when(F.col("n_low") > 0, "low_overlap"))
    own = own.withColumn("reasons", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ","))
    return own.withColumn("reliable", F.col("reasons") == "").drop("_down")


def exact_passages(texts: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """(doc_id, item_id) pairs where a text holds an item's whole normalised words in sequence.

    Both sides meet on hashed runs of ``words`` words, or as many as a shorter item has; only the hashes of a text that
    some item begins with leave it. The texts themselves then join the few pairs to be compared.
    """
    begun = items.where(F.size("words") > 0).select("item_id", "words", F.least(F.size("words"), F.lit(words)).alias("_k"))
    starts = begun.select("item_id", "_k", F.xxhash64(F.slice("words", F.lit(1), F.col("_k"))).alias("_h"))
    sizes = sorted(r[0] for r in starts.select("_k").distinct().collect())  # at most ``words`` rows
    if not sizes:
        return texts.select("doc_id").join(items.select("item_id"), F.lit(False))
    own = texts.select("doc_id", "words")

    def runs_of(k: int) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(k))))
        return own.where(F.size("words") >= k).select("doc_id", F.lit(k).alias("_k"), F.explode(F.array_distinct(hashes)).alias("_h"))

    runs = [runs_of(k) for k in sizes]
    every = runs[0]
    for more in runs[1:]:
        every = every.union(more)
    pairs = every.join(starts, ["_k", "_h"]).select("doc_id", "item_id").distinct()
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    both = pairs.join(own.select("doc_id", joined("words").alias("_text")), "doc_id").join(begun.select("item_id", joined("words").alias("_item")), "item_id")
    return both.where(F.contains("_text", F.col("_item"))).select("doc_id", "item_id").distinct()
