"""Language identification by prediction by partial matching (PPM, escape method C) with frozen statistics.

For each language a byte context tree of order three is counted on a bounded sample: 256 byte values, and a start symbol that
stands before each text and is never coded. With frozen statistics the code length of a byte depends on its last three symbols
only. For each order, what any language saw after a context is an entry with the code length in every language, escapes to
shorter contexts already paid; and each context has the price of escaping from it. A text's code length is a sum: of the entry
of the longest context that has one, and of the escapes above it. No context and no byte value is dropped or merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fernwerk.llm import kernels as K

#: Texts of each language that the statistics are counted on, by order of a hash of the id. With them the model is bounded:
#: it has at most one entry a byte of these texts, order and language.
DOCS_PER_LANG = 1200
ORDER = 3
START = 256
_BITS = 9
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Table:
    """Numbers of keys by open addressing; looks up whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = max(4, 1 << int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size, -1, np.int64)
        self.number = np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._at(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.number[at[put]] = keys[put], put
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for none."""
        at = self._at(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.number[at], -1)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.number[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


@dataclass
class Model:
    langs: list[str]
    entries: list[tuple[Table, np.ndarray]]  # of each order: context and symbol -> code lengths
    escapes: list[tuple[Table, np.ndarray]]  # of each order: context -> code lengths of the escape


def _padded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, their bounds, and for each byte the number of it and the three symbols before."""
    data, off = K.buffers(batch.column("text"))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = np.full(len(data) + ORDER * (len(off) - 1), START, np.int64)
    at = np.arange(len(data)) + ORDER * (doc + 1)
    out[at] = data
    gram = out[at - 3]
    for i in (2, 1, 0):
        gram = gram << _BITS | out[at - i]
    return data, off, gram


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.chunks(batches, max_bytes=1 << 20):
        _, off, gram = _padded(b)
        langs, code = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for i, lang in enumerate(langs):
            g, n = np.unique(gram[code[doc] == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])


def model(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The frozen trees of all languages from their counts of four symbols (three of context)."""
    size = len(langs)
    out = Model(langs, [], [])
    below_keys, below = np.zeros(0, np.int64), np.zeros((0, size))
    for order in range(ORDER + 1):
        keys, at = np.unique(gram & ((1 << _BITS * (order + 1)) - 1), return_inverse=True)
        hits = np.zeros((len(keys), size))
        np.add.at(hits, (at, lang), n)
        contexts, of = np.unique(keys >> _BITS, return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, hits)
        np.add.at(kinds, of, (hits > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(hits / (total + kinds)[of])
        if order:
            lower = below[np.searchsorted(below_keys, keys & ((1 << _BITS * order) - 1))]
        else:
            lower = np.full((len(keys), size), 8.0)  # all 256 bytes alike
        below_keys, below = keys, np.where(hits > 0, own, escape[of] + lower)
        out.entries.append((Table(keys), below.astype(np.float32)))
        out.escapes.append((Table(contexts), escape.astype(np.float32)))
    return out


def sampled(labelled: DataFrame, docs_per_lang: int) -> DataFrame:
    """(id) of the first ids of each language by a hash. A language's ids are first cut at a hash below which about that many, and
    some more, are to be expected from its count, so that no task ranks all ids of a language."""
    spark = labelled.sparkSession
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    want = docs_per_lang + 8 * docs_per_lang**0.5 + 100
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return labelled.select("id").limit(0)
    limits = spark.createDataFrame([(r["lang"], int(min(1.0, want / r["n"]) * (1 << 40))) for r in counts], "lang string, most long")
    some = labelled.select("id", "lang").join(F.broadcast(limits), "lang").withColumn("at", at).where(F.col("at") <= F.col("most"))
    rank = Window.partitionBy("lang").orderBy("at", "id")
    return some.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= docs_per_lang).select("id").distinct()


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """From rows (id, text, lang) with non-null text and lang: at most ``docs_per_lang`` whole texts a language.

    The counts of four symbols come to the driver: their number is bounded by the sample.
    """
    ids = F.broadcast(sampled(labelled, docs_per_lang))  # at most docs_per_lang a language
    grams = labelled.join(ids, "id", "left_semi").select("lang", "text").mapInArrow(K.tidy(_count), "lang string, gram long, n long")
    rows = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    if not names:
        return Model([], [], [])
    return model(names, np.searchsorted(np.array(names), rows["lang"].to_numpy(zero_copy_only=False).astype(str)), rows["gram"].to_numpy(), rows["n"].to_numpy())


def code_lengths(trees: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text in each language, and the texts' bytes."""
    _, off, gram = _padded(batch)
    cost = np.zeros((len(gram), len(trees.langs)), np.float32)
    todo = np.arange(len(gram))
    for order in range(ORDER, -1, -1):
        key = gram[todo] & ((1 << _BITS * (order + 1)) - 1)
        table, bits = trees.entries[order]
        found = table.find(key)
        hit = found >= 0
        cost[todo[hit]] += bits[found[hit]]
        todo, key = todo[~hit], key[~hit]
        table, bits = trees.escapes[order]
        found = table.find(key >> _BITS)
        hit = found >= 0
        cost[todo[hit]] += bits[found[hit]]
    cost[todo] += 8
    out = np.zeros((len(off) - 1, len(trees.langs)))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(cost, off[full], axis=0, dtype=np.float64)
    return out, np.diff(off)


def _predict(share: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = share.value
        for b in K.chunks(batches, max_bytes=1 << 19):
            data, off = K.buffers(b.column("text"))
            letters = np.concatenate([[0], np.cumsum(_LETTERS[data])])
            has = letters[off[1:]] > letters[off[:-1]]
            for i in np.flatnonzero(~has & (np.diff(off) > 0)):
                has[i] = any(map(str.isalpha, b.column("text")[int(i)].as_py()))
            if trees.langs:
                bits, size = code_lengths(trees, b)
                best = bits.argmin(1)
                away = (bits - bits.min(1, keepdims=True)) * np.log(2) / np.sqrt(np.maximum(size, 1))[:, None]
                score = 1 / np.exp(-np.minimum(away, 700)).sum(1)
            else:
                best, score, has = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            names = [*trees.langs, "und"]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([names[j] if h else "und" for j, h in zip(best.tolist(), has.tolist())]), pa.array(np.where(has, score, 0.0))], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train_on: str = "true", docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score): the language whose frozen trees give the whole text the shortest code.

    train_on: SQL condition, over a column ``id``, of the rows that may be learned from; rows with a null text or language are never.
    score: share of the best language, from code length differences per root of the text's bytes. A null text, a text
    without a letter, or a model without languages gives ``und`` and 0. Equal code lengths: the first name in order. Each row is
    predicted by itself, whatever its id; of rows repeated with one id all texts are learned from if the id is in the sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    trees = train(rows.where(train_on).where("text is not null and lang is not null"), docs_per_lang)
    share = docs.sparkSession.sparkContext.broadcast(trees)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(K.tidy(_predict(share)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
