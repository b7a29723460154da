"""Language identification with interpolated Kneser-Ney character models.

For each language a model of order five counts character sequences of a bounded sample of labelled texts: at
most DOCS_PER_LANGUAGE documents, drawn by a hash of their id.
All probabilities stand in sorted arrays of hashes; a text gets the language of the lowest cross-entropy a
letter, and a calibrated bound on that cross-entropy rejects texts that fit none of the languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

ORDER = 5
DOCS_PER_LANGUAGE = 500  # the bound of the sample: so many documents of each language
CHARS = 8_000_000  # and no further document of a language once those before hold so many characters
CALIBRATION = 5  # each fifth document of the sample calibrates and is not counted
BOUND_SHARE = 0.95  # of the calibrating documents, those that set a language's bound; the rest may be junk
MOST_LETTERS = 4000  # the model's alphabet; rarer letters share one id, so that a sequence of ORDER letters fits into 63 bits
BLOCK = 400_000  # characters that are scored at once
ROWS = 1000  # texts that are held at once

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, so that different sequences never share a hash."""
    x = codes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) * _MIX


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Alphabet:
    """Letters, folded to lower case, as small ids; 0 is anything between words."""

    def __init__(self, texts: list[str]):
        counts = np.zeros(0x110000, np.int64)
        for x in texts:
            np.add.at(counts, np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), 1)
        of: dict[str, int] = {}
        for c in np.flatnonzero(counts).tolist():
            if chr(c).isalpha():
                low = chr(c).lower()[0]
                of[low] = of.get(low, 0) + int(counts[c])
        self.letters = sorted(of, key=lambda c: (-of[c], c))[:MOST_LETTERS]
        self.size = len(self.letters) + 2  # with 0 and the id of other letters
        self.bits = max(1, (self.size - 1).bit_length())
        self.order = ORDER
        self._table = None

    def table(self) -> np.ndarray:
        """The id of each code point; made where it is used, as it would be 2 MB to send."""
        if self._table is None:
            ids = {c: i + 1 for i, c in enumerate(self.letters)}
            other = self.size - 1
            self._table = np.fromiter((ids.get(chr(c).lower()[0], other) if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint16, 0x110000)
        return self._table

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def ids(self, text: str) -> np.ndarray:
        """A text's letters with one 0 before, between and after words; empty if it has no letter."""
        x = self.table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate([[0], x, [0]]).astype(np.uint16)
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        return x if len(x) > 1 else x[:0]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """For each letter or 0 after the first, the code of the last ``order`` ids (zeros before the start)."""
        out = np.zeros(len(ids), np.int64)
        for back in range(self.order):
            out[back:] |= ids[: max(0, len(ids) - back)].astype(np.int64) << (back * self.bits)
        return out[1:]


class KneserNey:
    """One language: sorted hashes of sequences and contexts of each length, with discounted shares and back-off weights."""

    def __init__(self, codes: np.ndarray, order: int, bits: int, size: int):
        self.order, self.bits, self.size = order, bits, size
        self.levels = [None] * (order + 1)
        grams, counts = np.unique(codes, return_counts=True)
        for n in range(order, 0, -1):
            context = grams >> bits if n == order else (grams & ((1 << (n * bits)) - 1)) >> bits
            # as the code's lowest bits hold the last letter, the context is what stands above
            own, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, counts)
            kinds = np.bincount(at)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            d = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
            share = np.maximum(counts - d, 0) / total[at]
            weight = d * kinds / total
            g, c = _hash(grams), _hash(own)
            i, j = np.argsort(g), np.argsort(c)
            self.levels[n] = (g[i], share[i].astype(np.float32), c[j], weight[j].astype(np.float32))
            if n > 1:  # the next shorter sequences count the kinds of letters before them
                grams, counts = np.unique(grams & ((1 << ((n - 1) * bits)) - 1), return_counts=True)

    def log(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / self.size)
        for n in range(1, self.order + 1):
            g, share, c, weight = self.levels[n]
            own = codes & ((1 << (n * self.bits)) - 1)
            at, there = _find(c, _hash(own >> self.bits))
            w = np.where(there, weight[at], 1.0) if len(c) else 1.0
            at, there = _find(g, _hash(own))
            p = p * w + (np.where(there, share[at], 0.0) if len(g) else 0.0)
        return np.log(p)


@dataclass
class Model:
    """What tells languages apart; its size is bounded by the sample's."""

    languages: list[str]
    alphabet: Alphabet
    parts: list[KneserNey]
    keys: np.ndarray | None = None
    logs: np.ndarray | None = None
    scale: float = 1.0
    bounds: np.ndarray | None = None

    def known(self, codes: list[np.ndarray]) -> None:
        """Sum up the levels once for all sequences of the sample."""
        own = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        h = _hash(own)
        i = np.argsort(h)
        self.keys = h[i]
        self.logs = np.stack([k.log(own[i]) for k in self.parts], 1).astype(np.float32)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        at, there = _find(self.keys, _hash(codes))
        out = self.logs[at] if len(self.keys) else np.zeros((len(codes), len(self.parts)), np.float32)
        if not there.all():
            rest = codes[~there]
            out[~there] = np.stack([k.log(rest) for k in self.parts], 1)
        return out

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-likelihood in each language, and its number of scored letters. Null counts as empty."""
        sums, lengths = np.zeros((len(texts), len(self.parts))), np.zeros(len(texts), np.int64)
        for a, b in common.blocks(texts, BLOCK):
            parts = [(self.alphabet.codes(x) if len(x := self.alphabet.ids(t)) else np.zeros(0, np.int64)) if t else np.zeros(0, np.int64) for t in texts[a:b]]
            lengths[a:b] = [len(x) for x in parts]
            doc = np.repeat(np.arange(b - a), lengths[a:b])
            codes = np.concatenate(parts)
            for s in range(0, len(codes), 2 * BLOCK):  # a longer text is scored in pieces
                self._add(sums[a:b], codes[s : s + 2 * BLOCK], doc[s : s + 2 * BLOCK])
        return sums, lengths

    def _add(self, sums: np.ndarray, codes: np.ndarray, doc: np.ndarray) -> None:
        shift = max(1, int(doc[-1]).bit_length())
        if shift + self.alphabet.order * self.alphabet.bits > 63:
            own, at = np.unique(codes, return_inverse=True)
        else:  # one sort brings equal sequences together and keeps their documents
            keys = np.sort((codes << shift) | doc)
            doc, codes = keys & ((1 << shift) - 1), keys >> shift
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            own, at = codes[new], np.cumsum(new) - 1
        logs = self._logs(own)
        for k in range(logs.shape[1]):
            sums[:, k] += np.bincount(doc, logs[:, k][at], minlength=len(sums))

    def judge(self, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language (``und`` without letters), calibrated probability, cross-entropy a letter in bits, rejected or not."""
        if not self.parts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        sums, n = self.sums(texts)
        best = sums.argmax(1)
        rate = sums / np.maximum(n, 1)[:, None]
        z = rate * self.scale * np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p = p.max(1) / p.sum(1)
        bits = np.where(n > 0, -rate[np.arange(len(best)), best] / np.log(2), np.nan)
        rejected = (n == 0) | (bits > self.bounds[best] + 6 / np.sqrt(np.maximum(n, 1)))
        names = [self.languages[k] if m else "und" for k, m in zip(best.tolist(), n.tolist(), strict=True)]
        return names, np.where(n > 0, p, 0.0), bits, rejected


def train(rows: list[tuple[str, str, int]]) -> Model:
    """A model from (language, text, number) rows; each CALIBRATION-th number calibrates."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    languages = sorted({r[0] for r in rows})
    alphabet = Alphabet([r[1] for r in rows])
    fit = {k: [] for k in languages}
    held = []
    for k, text, number in rows:
        if number % CALIBRATION or not fit[k]:
            fit[k].append(alphabet.codes(alphabet.ids(text)))
        else:
            held.append((k, text))
    parts = [KneserNey(np.concatenate(fit[k]), alphabet.order, alphabet.bits, alphabet.size) for k in languages]
    model = Model(languages, alphabet, parts, bounds=np.full(len(languages), np.inf))
    if not parts:
        return model
    model.known([x for k in languages for x in fit[k]])
    if held:
        sums, n = model.sums([t for _, t in held])
        true = np.array([languages.index(k) for k, _ in held])
        rate = sums / np.maximum(n, 1)[:, None]
        losses = []
        for scale in (0.5, 1, 2, 4, 8, 16):  # the temperature of the lowest loss
            z = rate * scale * np.sqrt(np.maximum(n, 1))[:, None]
            z = z - z.max(1, keepdims=True)
            losses.append((float((np.log(np.exp(z).sum(1)) - z[np.arange(len(true)), true]).mean()), scale))
        model.scale = min(losses)[1]
        bits = -rate[np.arange(len(true)), true] / np.log(2)
        fits = (rate.argmax(1) == true) & (n >= 50)  # a mislabelled document fits another language better
        for k in range(len(languages)):
            own = bits[fits & (true == k)]
            if len(own) >= 5:
                high = np.quantile(own, BOUND_SHARE)
                model.bounds[k] = high + 3 * own[own <= high].std() + 0.5
    return model


def fit(documents: DataFrame, where=None) -> Model:
    """Learn from at most DOCS_PER_LANGUAGE documents a language, of those with text, ``lang`` and ``doc_id``.

    Of rows that repeat an id the least (lang, text) counts. No text is too long to be learned from.
    """
    rows = common.bounded_sample(documents if where is None else documents.where(where), "lang", DOCS_PER_LANGUAGE, CHARS)
    return train([(r.lang, r.text, i) for i, r in enumerate(sorted(rows, key=lambda r: r.doc_id))])


def identify(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``documents`` with lang_pred, score, bits (cross-entropy a letter) and rejected.

    One pass without a shuffle. Null, empty or letterless text: ``und``, score 0, rejected. Repeated rows and ids are
    each judged by their own text. Columns in ``keep`` with the name of an added one are refused.
    """
    common.fresh(keep, ["lang_pred", "score", "bits", "rejected"])
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)  # a text travels once
    source = documents.select(*keep) if "text" in keep else documents.select(*keep, F.col("text").alias("_scored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                names, p, bits, rejected = own.judge(part.column(at).to_pylist())
                added = [pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(bits, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *added], names=[*keep, "lang_pred", "score", "bits", "rejected"])

    return source.mapInArrow(common.lean(run), f"{schema}, lang_pred string, score double, bits double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside fold 1 of 3."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.fold("doc_id", 3) != 1)
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits", "rejected")
