"""Benchmark decontamination: windows of training words looked up in a broadcast hash set of test n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernwerk.llm import kernels as K
from fernwerk.llm.repeats import keyed

#: Bytes of test text in one broadcast block; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 16 << 20
_HITS = "k long, n_words long, n_hit long, items array<string>, spans array<struct<lo:int,hi:int>>"


def _normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = K.buffers(text)
    data = K.LOWER[data]
    return data, *K.words(data, off, K.ALNUM)


def ngram_block(items: list[tuple[str, str]], n: int) -> dict:
    """For each window length: sorted hashes with the windows' words and items. An item of fewer than n words is one window."""
    data, starts, ends, bounds = _normal(pa.array([x for _, x in items], pa.string()))
    roll = K.Rolling(K.word_hashes(data, starts, ends))
    by: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = defaultdict(dict)
    for i, (item, _) in enumerate(items):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if lo == hi:
            continue
        m = min(n, hi - lo)
        at = np.arange(lo, hi - m + 1)
        for j, h in zip(at.tolist(), roll.of(at, m).tolist()):
            words = b" ".join(data[s:e].tobytes() for s, e in zip(starts[j : j + m], ends[j : j + m]))
            same = by[m].setdefault(h, [])
            for w, owners in same:
                if w == words:
                    owners.add(item)
                    break
            else:
                same.append((words, {item}))
    out = {}
    for m, found in by.items():
        hashes = np.array(sorted(found), np.uint64)
        quick = np.zeros(1 << 20, bool)
        quick[(hashes >> np.uint64(44)).astype(np.int64)] = True
        out[m] = (hashes, quick, [found[int(h)] for h in hashes])
    return out


def _scan(block: object, all_rows: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=4 << 20):
            data, starts, ends, bounds = _normal(b.column("text"))
            roll = K.Rolling(K.word_hashes(data, starts, ends))
            lo, hi, items = [], [], defaultdict(set)
            for m, (hashes, quick, found) in block.value.items():
                h = roll.all(m)
                at = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
                pos = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                hit = hashes[pos] == h[at]
                at, pos = at[hit], pos[hit]
                doc = np.searchsorted(bounds, at, side="right") - 1
                fits = at + m <= bounds[doc + 1]
                for i, p, d in zip(at[fits].tolist(), pos[fits].tolist(), doc[fits].tolist()):
                    words = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + m], ends[i : i + m]))
                    for w, owners in found[p]:
                        if w == words:
                            lo.append(i)
                            hi.append(i + m)
                            items[d] |= owners
            gone = K.cover(np.array(lo, np.int64), np.array(hi, np.int64), len(starts))
            count = np.concatenate([[0], np.cumsum(gone)])
            n_hit = count[bounds[1:]] - count[bounds[:-1]]
            take = np.arange(len(bounds) - 1) if all_rows else np.flatnonzero(n_hit)
            spans = []
            for i in take.tolist():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[bounds[i] : bounds[i + 1]].view(np.int8), [0]]))) if n_hit[i] else ()
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            own = [c for c in ("k", "d") if c in b.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(take)) for c in own), pa.array(np.diff(bounds)[take]), pa.array(n_hit[take].astype(np.int64)), pa.array([sorted(items.get(i, ())) for i in take.tolist()], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                [*own, "n_words", "n_hit", "items", "spans"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks found of a text, as one; other columns stay."""
    kind = {"n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))}
    for b in batches:
        out: dict[str, list] = {c: [] for c in kind}
        for all_spans, all_items in zip(b.column("all_spans").to_pylist(), b.column("all_items").to_pylist()):
            merged: list[list[int]] = []
            for x, y in sorted((s["lo"], s["hi"]) for x in all_spans or () for s in x):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            out["n_hit"].append(sum(y - x for x, y in merged))
            out["items"].append(sorted({i for x in all_items or () for i in x}))
            out["spans"].append([{"lo": x, "hi": y} for x, y in merged])
        rest = [c for c in b.schema.names if not c.startswith("all_")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(out[c], kind[c]) for c in kind)], [*rest, *kind])


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of ``ngram_block``; the driver holds the text of one block at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    share, held, size = [], [], 0

    def put() -> None:
        share.append(benchmark.sparkSession.sparkContext.broadcast(ngram_block(held, n)))

    for item, text in items.toLocalIterator(prefetchPartitions=True):
        held.append((item, text))
        size += len(text) * 2
        if size >= block_bytes:
            put()
            held, size = [], 0
    if held or not share:
        put()
    return share


def _digest(text: str) -> F.Column:
    """What a text is merged by: equal texts have equal hits, whatever their ids."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def _hits(texts: DataFrame, share: list) -> DataFrame:
    """(d, n_hit, items, spans) of each distinct text that any block hits, from rows (d, text)."""
    found = None
    for block in share:
        one = texts.mapInArrow(K.tidy(_scan(block, False)), "d string, " + _HITS.removeprefix("k long, "))
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("d").agg(F.collect_set("spans").alias("all_spans"), F.collect_set("items").alias("all_items"))
    return merged.mapInArrow(K.tidy(_merge), "d string, n_hit long, items array<string>, spans array<struct<lo:int,hi:int>>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every document: its words in windows of test items, the items, and runs of hit words.

    Words are runs of ASCII letters (in either case) and digits and of all characters beyond ASCII. Hits are verified word by word.
    The benchmark goes to the executors in blocks of at most ``block_bytes`` of text: one block, the usual case, needs no
    shuffle; of more blocks, the hits are merged by a digest of the text, and each row keeps its own result. Null texts have no
    words; a null item id is the empty string; items without words hit nothing; equal item ids count once.
    """
    rows = keyed(docs, id_col, text_col)
    share = _blocks(benchmark, n, block_bytes)
    if len(share) == 1:
        found = rows.mapInArrow(K.tidy(_scan(share[0], True)), _HITS)
    else:
        rows = rows.withColumn("d", _digest("text"))
        none = docs.sparkSession.sparkContext.broadcast({})
        words = rows.mapInArrow(K.tidy(_scan(none, True)), _HITS.replace("k long", "k long, d string")).select("k", "d", "n_words")
        both = words.join(_hits(rows.select("d", "text"), share), "d", "left")
        empty = {c: F.array().cast(t) for c, t in (("items", "array<string>"), ("spans", "array<struct<lo:int,hi:int>>"))}
        found = both.select("k", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *(F.coalesce(c, e).alias(c) for c, e in empty.items()))
    return found.withColumn("k", F.when(F.col("k") != -(2**63), F.col("k"))).withColumnRenamed("k", id_col)


def _clean(block: object | None, reject_items: int) -> Callable:
    """Without a block, the columns _items and _spans have what was found."""
    scan = _scan(block, True) if block else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=4 << 20):
            if scan:
                found = pa.Table.from_batches(scan(iter([pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("text")], ["k", "text"])])))
                hits = found.column("items").to_pylist(), found.column("spans").to_pylist()
            else:
                hits = b.column("_items").to_pylist(), b.column("_spans").to_pylist()
                b = b.select([c for c in b.schema.names if c not in ("_items", "_spans")])
            texts = b.column("text").to_pylist()
            keep, out = [], []
            for i, (items, spans) in enumerate(zip(*hits)):
                if len(items or ()) >= reject_items:
                    continue
                keep.append(i)
                if not spans:
                    out.append(texts[i])
                    continue
                raw = texts[i].encode()
                data = K.LOWER[np.frombuffer(raw, np.uint8)]
                starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
                edge = [0, *(x for s in spans for x in (int(starts[s["lo"]]), int(ends[s["hi"] - 1]))), len(raw)]
                out.append(b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2])).decode())
            t = b.take(pa.array(keep, pa.int64()))
            yield t.set_column(t.schema.get_field_index("text"), "text", pa.array(out, t.schema.field("text").type))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, reject_items: int = 2, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Drops documents with windows of ``reject_items`` items or more and cuts the hit words of the others; all columns stay.

    The benchmark is scanned in blocks as in `contamination`; of more than one block, the hits are merged before any text is cut.
    """
    share = _blocks(benchmark, n, block_bytes)
    at = docs.columns.index(text_col)
    named = docs.toDF(*("text" if i == at else f"c{i}" for i in range(len(docs.columns))))
    if len(share) == 1:
        return named.mapInArrow(K.tidy(_clean(share[0], reject_items)), named.schema).toDF(*docs.columns)
    keyed_ = named.withColumn("d", _digest("text"))
    hits = _hits(keyed_.select("d", "text"), share).select("d", F.col("items").alias("_items"), F.col("spans").alias("_spans"))
    return keyed_.join(hits, "d", "left").drop("d").mapInArrow(K.tidy(_clean(None, reject_items)), named.schema).toDF(*docs.columns)


def items_digest(items: str = "items") -> F.Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def brute_force(docs: list[tuple[int, str | None]], bench: list[tuple[str, str]], n: int = 8) -> dict[int, tuple]:
    """The same by comparison of word tuples, for tests."""
    import re

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    win: dict[tuple, set] = defaultdict(set)
    for i, t in bench:
        w = words(t)
        m = min(n, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            win[tuple(w[j : j + m])].add(str(i))
    sizes = {len(x) for x in win}
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in win:
                    hit |= set(range(j, j + m))
                    items |= win[x]
        out[d] = (len(w), len(hit), len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2)
    return out
