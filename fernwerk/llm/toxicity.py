"""Toxicity by a learned, weighted lexicon of words and stems, matched by an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fernwerk.llm import kernels as K
from fernwerk.storage import materialise

#: Labelled rows that the lexicon is learned from, by order of a hash of the id.
SAMPLE_ROWS = 16_000
#: Entries of the lexicon, and exception phrases, the most telling first: parameters that bound what is learned from the sample.
MAX_ENTRIES = 20_000
STEM = range(4, 9)
#: Letters that look like Latin ones after compatibility folding, and digits and signs that are written for letters (fixed values).
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɪ": "i", "ʀ": "r", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ᴀ": "a", "ᴇ": "e", "ᴏ": "o", "ᴜ": "u", "ꮯ": "c"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "€": "e"}
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
_ASCII_FOLD = str.maketrans({k: v for k, v in DIGITS.items() if k.isascii()})
_WORD = regex.compile(r"\p{L}+").findall
_NEXT = regex.compile(r"\p{L}+").search
#: Searches backwards from the end.
_LAST = regex.compile(r"(?r)(\p{L}+)").search
#: Marks, joiners and other characters without a width.
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")


def fold(text: str) -> str:
    """Lower case, look-alike letters and digits as the letters they stand for.

    Beyond ASCII first the compatibility form (full-width, mathematical and ligature letters as plain ones), without accents and
    invisible characters.
    """
    if text.isascii():
        return text.lower().translate(_ASCII_FOLD)
    text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Two words in which an entry is not toxic.
    exceptions: set[str] = field(default_factory=set)
    #: Of the logistic score: constant, weight sum, weight per root of the words.
    fit: tuple[float, float, float] = (-2.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for w in lexicon.words:
            self.automaton.add_word(w, (w, False))
        for w in lexicon.stems:
            self.automaton.add_word(w, (w, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words of a folded text that are entries; the heaviest entry of a word counts."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        for last, (entry, stem) in self.automaton.iter(text):
            start, end = last + 1 - len(entry), last + 1
            if start and text[start - 1].isalpha():
                continue
            if end < len(text) and text[end].isalpha():
                if not stem:
                    continue
                while end < len(text) and text[end].isalpha():
                    end += 1
            weight = self.lexicon.stems[entry] if stem else self.lexicon.words[entry]
            if start not in best or best[start][1] < weight:
                best[start] = (end, weight)
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def features(self, text: str) -> tuple[float, float]:
        """Weight of the entries outside exception phrases, and the same per root of the number of words."""
        folded = fold(text)
        total = 0.0
        for s, e, w in self.hits(folded):
            if not (self.lexicon.exceptions and self.lexicon.exceptions.intersection(phrases(folded, s, e))):
                total += w
        return (math.log1p(total), math.log1p(100 * total / (folded.count(" ") + folded.count("\n") + 1))) if total else (0.0, 0.0)

    def score(self, text: str) -> float:
        a, b = self.features(text)
        c, x, y = self.lexicon.fit
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, c + x * a + y * b))))


def phrases(text: str, s: int, e: int) -> list[str]:
    """The word at [s, e) with the word before and with the word after it, whatever stands between."""
    word, out = text[s:e], []
    before = _LAST(text, 0, s)
    after = _NEXT(text, e)
    if before:
        out.append(f"{before[1]} {word}")
    if after:
        out.append(f"{word} {after[0]}")
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, by label, that hold each word ('=word') or word beginning ('word')."""
    for b in K.chunks(batches, max_bytes=1 << 20):
        count = {0: Counter(), 1: Counter()}
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            words = set(_WORD(fold(text or "")))
            own = {"=" + w for w in words if len(w) > 1}
            for n in STEM:
                own.update(w[:n] for w in words if len(w) > n)
            count[label].update(own)
        names = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["piece", "pos", "neg"])


def choose(rows: list[tuple[str, int, int]], pos: int, neg: int, max_entries: int) -> Lexicon:
    """Entries whose documents are toxic far more often than chance explains, given that so many pieces were tried."""
    base = (pos + 0.5) / (pos + neg + 1)
    weight = {}
    for piece, p, n in rows:
        rate = p / (p + n)
        if rate <= base:
            continue
        gain = p * math.log(rate / base) + (n * math.log((1 - rate) / (1 - base)) if n else 0.0)
        if gain > math.log(max(len(rows), 2)) + 1 and rate >= 0.7:
            weight[piece] = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1)), p
    best = dict(sorted(weight.items(), key=lambda x: (-x[1][1], x[0]))[:max_entries])
    stems = {k: v for k, v in best.items() if k[0] != "="}
    # a beginning is kept in its longest form that still has nearly all its documents, and not if a kept shorter one covers it
    longest: set[str] = set()
    for s in sorted(stems, key=len):
        if any(t.startswith(s) and len(t) > len(s) and stems[t][1] >= 0.95 * stems[s][1] for t in stems if t[:4] == s[:4]):
            continue
        if not any(s[:n] in longest for n in range(min(STEM), len(s))):
            longest.add(s)
    words = {k[1:]: v[0] for k, v in best.items() if k[0] == "="}
    # a beginning that is there because of one word only is that word
    alone = {s for s in longest if any(w.startswith(s) and best["=" + w][1] >= 0.95 * stems[s][1] for w in words)}
    return Lexicon(words, {s: stems[s][0] for s in longest - alone})


def _measure(share: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(share.value)
        for b in K.chunks(batches, max_bytes=2 << 20):
            near, a, c = [], [], []
            for text in b.column("text").to_pylist():
                folded = fold(text or "")
                near.append(sorted({p for s, e, _ in matcher.hits(folded) for p in phrases(folded, s, e)}))
                x, y = matcher.features(text or "")
                a.append(x)
                c.append(y)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(near, pa.list_(pa.string())), pa.array(a), pa.array(c)], ["label", "near", "a", "b"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a little ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, max_entries: int = MAX_ENTRIES) -> Lexicon:
    """From rows (id, text, label): at most ``sample_rows`` of them, written once. The lexicon and the sample's two figures a row come to
    the driver. Of pieces that may be entries, the ``10 * max_entries`` in most toxic rows are tried; ``max_entries`` bounds the
    entries and the exception phrases."""
    spark = labelled.sparkSession
    # counts of pieces are taken on the executors; only those with enough support in toxic rows can be entries
    rows = materialise(labelled.select(F.col("label").cast("int").alias("label"), "text"), "sample")
    pieces = rows.mapInArrow(K.tidy(_pieces), "piece string, pos long, neg long").groupBy("piece").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = rows.groupBy().agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    pos, total = int(totals[0]), int(totals[1])
    if not pos or pos == total:
        return Lexicon(fit=(math.log((pos + 0.5) / (total - pos + 0.5)), 0.0, 0.0))
    # by chance a piece of p toxic documents alone gains p * log(1 / base); fewer than this cannot pass the test of `choose`
    least = max(2, math.floor(math.log(1000) / math.log(total / pos)))
    most = pieces.where((F.col("pos") >= least) & (F.col("pos") * F.lit(float(total)) > (F.col("pos") + F.col("neg")) * F.lit(float(pos)) * 2)).orderBy(F.desc("pos"), "piece").limit(10 * max_entries)
    lexicon = choose([(r[0], r[1], r[2]) for r in most.toLocalIterator()], pos, total - pos, max_entries)
    schema = "label int, near array<string>, a double, b double"
    seen = rows.mapInArrow(K.tidy(_measure(spark.sparkContext.broadcast(lexicon))), schema)
    near = seen.select("label", F.explode("near").alias("phrase")).groupBy("phrase").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).where("n >= 3 and pos = 0").orderBy(F.desc("n"), "phrase").limit(max_entries)
    lexicon.exceptions = {r[0] for r in near.toLocalIterator()}
    if lexicon.exceptions:
        seen = rows.mapInArrow(K.tidy(_measure(spark.sparkContext.broadcast(lexicon))), schema)
    x = seen.select("label", "a", "b").toPandas()
    lexicon.fit = _logistic(x[["a", "b"]].to_numpy(), x["label"].to_numpy())
    return lexicon


def sample(docs: DataFrame, labels: DataFrame, train_on: str, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, label) of the first ``rows`` labelled ids, allowed by ``train_on``, by hash; copies count once, or their words would seem telling."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(train_on)
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id").dropDuplicates(["text", "label"])


def _score(share: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(share.value)
        for b in K.chunks(batches, max_bytes=2 << 20):
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "text"), pa.array([matcher.score(x or "") for x in b.column("text").to_pylist()], pa.float64())], [*(n for n in b.schema.names if n != "text"), "score"])

    return run


def _scored(docs: DataFrame, share: object, text_col: str) -> DataFrame:
    """The documents with their score as the last column; a column of that name before is dropped."""
    docs = docs.drop("score")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index(text_col)]))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    return rows.mapInArrow(K.tidy(_score(share)), schema).toDF(*docs.columns, "score")


def toxicity(docs: DataFrame, labels: DataFrame, train_on: str = "true", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: bool = False) -> DataFrame:
    """(id, score) of every document from its whole text: 0 to 1, higher for likelier toxic.

    train_on: SQL condition, over a column ``id``, of the labelled rows that may be learned from; a bounded sample of them is.
    Each row is scored by itself, whatever its id. Null and empty texts get the score of a text without entries. Labels other than 0 and 1 are left out; of several labels of an
    id the largest counts. Without labels of both kinds the score is the share of the label. No shuffle of texts.
    With ``keep``, all columns of the documents are returned, and the score after them.
    """
    lexicon = train(sample(docs, labels, train_on, id_col, text_col, label_col, sample_rows), sample_rows)
    share = docs.sparkSession.sparkContext.broadcast(lexicon)
    if keep:
        return _scored(docs, share, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(K.tidy(_score(share)), f"id {kind}, score double").withColumnRenamed("id", id_col)
