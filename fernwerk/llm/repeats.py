"""Repeated stretches of a corpus, for byte strings and for word passages.

A window of ``length`` units is repeated if its units also stand elsewhere. All windows are judged, none is
sampled: winnowing gives each window one anchor that depends on its content alone, so that equal windows share
an anchor, and neighbouring windows with one anchor travel as one row (a stretch: first window, number of windows).

1. Anchors that occur once are dropped: an aggregate of the anchors' hashes with map-side combine, then a join
   with the unique repeated hashes, whose hot keys adaptive execution can split.
2. Stretches with equal content are one *kind* with a count, so a group of copies of any size is one row after the
   map-side combine.
3. The text of one stretch a kind is fetched, and the kinds of an anchor meet in one task, a bounded chunk at a time. There bytes
   get a suffix array and the longest-previous-factor array from previous and next smaller positions (`lpf_heads`); words are
   compared, outward from the anchor to both sides (`extended_heads`). Either gives each window the earliest equal one.
   The windows of an anchor with more than ``hot`` kinds are aggregated by a cryptographic digest of their content instead.
4. Runs of windows with one earliest source are joined back to the stretches.

Rows are named by (k, r): the id, null as the least one, and a hash of the text; so rows without an id, or with the id of
another, keep texts and results apart, and rows with one id and text get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernwerk.llm import kernels as K
from fernwerk.storage import materialise

NO_ID = -(2**63)
#: Kinds of one anchor that meet in one task; windows of anchors with more are aggregated by digest.
HOT = 2000
_LUT = K.mix(np.arange(1, 257, dtype=np.uint64) * K._C1)
_ROWS = "h long, c long, k long, r long, lo int, n int, at int"
_BODIES = "hot boolean, h long, c long, k long, r long, lo long, off int, n int, at int, times long, body binary"
_RUNS = "h long, c long, off int, size int, src_k long, src_r long, src_lo long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (k, text): the id with null as the least one. Other columns, whatever their names, stay out of the plan."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"))


def row_keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, r, text): `keyed`, and a hash of the text that tells rows of one id apart."""
    rows = keyed(docs, id_col, text_col)
    return rows.select("k", F.xxhash64("text").alias("r"), "text")


def units(batch: pa.RecordBatch, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, a 64-bit value for each unit, the documents' bounds in units, and where each unit starts and ends in the bytes."""
    data, off = K.buffers(batch.column("text"))
    if unit == "byte":
        at = np.arange(len(data) + 1)
        return data, _LUT[data], off, at[:-1], at[1:]
    starts, ends, bounds = K.words(data, off, K.SPACED)
    return data, K.word_hashes(data, starts, ends), bounds, starts, ends


def _anchor_rows(unit: str, length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=(1 if unit == "byte" else 4) << 19):
            _, values, bounds, _, _ = units(b, unit)
            if len(values) < length:
                continue
            grams = K.Rolling(values).all(gram)
            doc, lo, n, at = K.anchors(grams, bounds, length, gram)
            c = K.Rolling(values, 0xD1342543DE82EF95).of(lo, n + length - 1)
            k, r = (b.column(x).to_numpy()[doc] for x in ("k", "r"))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(grams[at])), pa.array(K.signed(c)), pa.array(k), pa.array(r), pa.array((lo - bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((at - lo).astype(np.int32))], ["h", "c", "k", "r", "lo", "n", "at"])

    return run


def _bodies(unit: str, length: int, hot: int) -> Callable:
    """Documents with the stretches wanted of them -> stretches with their text; of hot anchors, windows with a digest of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=1 << 20):
            data, _, bounds, starts, ends = units(b, unit)
            lists = b.column("want")
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            h, c, lo, n, at, times, kinds = (flat.field(x).to_numpy() for x in ("h", "c", "lo", "n", "at", "times", "kinds"))
            n = n.astype(np.int64)
            k, r = (b.column(x).to_numpy()[doc] for x in ("k", "r"))
            first = bounds[doc] + lo
            cold, many = np.flatnonzero(kinds <= hot), np.flatnonzero(kinds > hot)
            for i in range(0, len(cold), 2000):
                j = cold[i : i + 2000]
                s, e = starts[first[j]], ends[first[j] + n[j] + length - 2]
                at_byte, _ = K.spread(s, e - s)
                cuts = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(j), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[at_byte]))])
                yield _batch(j, np.zeros(len(j), np.int64), n[j], h, c, k, r, lo, at, times, bodies, False)
            for i in many.tolist():
                a, size = int(first[i]), int(n[i])
                if unit == "byte":
                    raw, s, e = data[a : a + size + length - 1].tobytes(), range(size), range(length, size + length)
                else:
                    words = [data[x:y].tobytes() for x, y in zip(starts[a : a + size + length - 1], ends[a : a + size + length - 1])]
                    raw = b" ".join(words)
                    last = np.cumsum([len(w) + 1 for w in words]) - 1
                    s, e = [0, *(last[: size - 1] + 1).tolist()], last[length - 1 :].tolist()
                digests = pa.array([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(s, e)], pa.binary())
                yield _batch(np.full(size, i), np.arange(size), np.ones(size, np.int64), h, c, k, r, lo, at, times, digests, True)

    return run


def _batch(j: np.ndarray, off: np.ndarray, n: np.ndarray, h, c, k, r, lo, at, times, bodies: pa.Array, hot: bool) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(j), hot)), *(pa.array(x[j]) for x in (h, c, k, r)), pa.array(lo[j].astype(np.int64)), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at[j].astype(np.int32)), pa.array(times[j].astype(np.int64)), bodies]
    return pa.RecordBatch.from_arrays(columns, ["hot", "h", "c", "k", "r", "lo", "off", "n", "at", "times", "body"])


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array to ``depth`` bytes by prefix doubling: the order, and for each depth on the way the ranks (equal for equal bytes).

    A rank is the place of the first suffix with the same bytes; suffixes that are alone with theirs are in place and sorted no more.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    have = min(8, depth)
    key = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - have))
    order = np.argsort(key)
    slots, pos, key = np.arange(n), order, key[order]
    rank = np.zeros(n, np.int32)
    levels: list[tuple[int, np.ndarray]] = []
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[pos] = slots[np.flatnonzero(new)][np.cumsum(new) - 1] if len(slots) else 0
        levels.append((have, rank.copy()))
        if have >= depth:
            return order, levels
        shared = ~new
        shared[:-1] |= ~new[1:]
        slots, pos = slots[shared], pos[shared]
        step = min(have, depth - have)
        after = pos + step
        key = rank[pos].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key)
        pos, key = pos[sort], key[sort]
        order[slots] = pos
        have += step


def smaller(sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix array the nearest place before, and after, that holds a smaller position; -1 for none."""

    def before(x: np.ndarray) -> np.ndarray:
        j = np.arange(-1, len(x) - 1)
        bound = np.append(x, -1)  # place -1 holds less than all
        todo = np.flatnonzero(bound[j] > x)
        while len(todo):  # all between j[i] and i is greater than x[i], so j may skip to j[j[i]]
            j[todo] = j[j[todo]]
            todo = todo[bound[j[todo]] > x[todo]]
        return j

    after = before(sa[::-1])[::-1]
    return before(sa), np.where(after >= 0, len(sa) - 1 - after, -1)


def common(levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to ``most``, from the ranks of the doubling."""
    n, got = len(data), np.zeros(len(a), np.int64)
    for depth, rank in [x for x in levels if x[0] & (x[0] - 1) == 0][::-1]:
        x, y = a + got, b + got
        ok = (x < n) & (y < n)
        got[ok] += depth * (rank[x[ok]] == rank[y[ok]])
    for _ in range(7):
        x, y = a + got, b + got
        ok = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = data[x[ok]] == data[y[ok]]
        if not same.any():
            break
        got += same
    return np.minimum(got, most)


def longest_previous_factors(data: np.ndarray, at: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at ``at`` (ascending): the longest prefix, up to ``length``, that also starts at an earlier one of them, and
    which; factors below ``least`` are given as 0, with -1. Of the earlier suffixes, the previous and the next smaller position in
    suffix order share most."""
    order, levels = suffix_order(data, length)
    mine = np.zeros(len(data), bool)
    mine[at] = True
    if least >= length:  # suffixes that are alone with their bytes have no such factor, nor are they one
        rank = levels[-1][1]
        mine &= np.bincount(rank, mine, len(data))[rank] > 1 if len(data) else False
    sa = order[mine[order]]
    p, q = smaller(sa)
    size = []
    for x in (p, q):
        found = np.zeros(len(sa), np.int64)
        ok = np.flatnonzero(x >= 0)
        if least >= length:
            found[ok] = length * (rank[sa[ok]] == rank[sa[x[ok]]])
        else:
            found[ok] = common(levels, data, sa[ok], sa[x[ok]], length)
        size.append(found)
    best = np.where(size[1] > size[0], q, p)
    place = np.searchsorted(at, sa)
    factor, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
    factor[place] = np.maximum(*size)
    source[place] = np.where((best >= 0) & (factor[place] >= max(least, 1)), place[best], -1)
    factor[source < 0] = 0
    return factor, source


def lpf_heads(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first window (index into ``at``) with the same bytes: from window to window by the longest previous factors."""
    factor, source = longest_previous_factors(data, at, length, length)
    head = np.where(factor >= length, source, np.arange(len(at)))
    while True:
        on = head[head]
        if (on == head).all():
            return head
        head = on


def exact_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only: words of one hash are compared with the first of them."""
    h = K.word_hashes(data, starts, ends)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    one = first[number]
    size = ends - starts
    same = size == size[one]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        mask = keep[np.minimum(size[todo] - k, 8)]
        same[todo] &= (lanes[starts[todo] + k] & mask) == (lanes[starts[one[todo]] + k] & mask)
        k += 8
        todo = todo[same[todo] & (size[todo] > k)]
    if not same.all():
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends)], np.int64)
    return number.astype(np.int64)


def extended_heads(words: np.ndarray, base: np.ndarray, size: np.ndarray, at: np.ndarray, n: np.ndarray, seed: np.ndarray, length: int, reach: int) -> np.ndarray:
    """The first window with the same words, for all windows of stretches in order of place.

    Stretches of one seed are aligned at their anchor (word ``at``) and compared outward, word by word: a step to the right or left
    parts the stretches that have agreed so far by their next word. A window is what agrees to both sides over its length.
    """
    rows = np.arange(len(base))
    most = int(words.max()) + 1 if len(words) else 1

    def parted(cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        there = (place >= 0) & (place < size)
        word = most + rows  # beyond its end a stretch agrees with none
        word[there] = words[base[there] + place[there]]
        return np.unique(cls * (most + len(rows)) + word, return_inverse=True)[1]

    right = [np.unique(seed, return_inverse=True)[1]]
    for i in range(length):
        right.append(parted(right[-1], at + i))
    left = right[0]
    begin = np.cumsum(n) - n
    head = np.arange(int(n.sum()))
    for i in range(reach + 1):
        if i:
            left = parted(left, at - i)
        mine = np.flatnonzero((at - i >= 0) & (at - i < n))
        if len(mine):
            window = begin[mine] + at[mine] - i
            _, first, number = np.unique(left[mine] * (len(rows) + 1) + right[length - i][mine], return_index=True, return_inverse=True)
            head[window] = window[first[number]]
    return head


def by_key(batches: Iterator[pa.RecordBatch], key: str, target: int) -> Iterator[pa.Table]:
    """Tables of about ``target`` bytes from batches sorted by key; no key is in two tables."""
    hold: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        hold.append(b)
        size += b.nbytes
        if size >= target:
            t = pa.Table.from_batches(hold).combine_chunks()
            k = t[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield t.slice(0, cut)
            hold = t.slice(cut).to_batches()
            size = sum(x.nbytes for x in hold)
    if hold:
        yield pa.Table.from_batches(hold).combine_chunks()


def _runs(unit: str, length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "h", 1 << 19):
            if not t.num_rows:
                continue
            order = np.lexsort(tuple(t[x].to_numpy() for x in ("lo", "r", "k")))
            h, c, k, r, lo, n, at, times = (t[x].to_numpy()[order] for x in ("h", "c", "k", "r", "lo", "n", "at", "times"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            body, ends = K.buffers(t["body"].combine_chunks() if t["body"].num_chunks != 1 else t["body"].chunk(0))
            size = np.diff(ends)[order]
            body = body[K.spread(ends[:-1][order], size)[0]]
            ends = np.concatenate([[0], np.cumsum(size)])
            inside, row = K.spread(np.zeros(len(n), np.int64), n)
            if unit == "byte":
                head = lpf_heads(body, ends[:-1][row] + inside, length)
            else:
                s, e, bounds = K.words(body, ends, K.SPACED)
                head = extended_heads(exact_words(body, s, e), bounds[:-1], np.diff(bounds), at, n, h, length, length - gram)
            start = lo[row] + inside
            often = np.bincount(head, times[row], len(head))[head] >= 2
            src_row, src_lo = row[head], start[head]
            begins = often.copy()
            begins[1:] &= ~(often[:-1] & (row[1:] == row[:-1]) & (src_row[1:] == src_row[:-1]) & (src_lo[1:] == src_lo[:-1] + 1))
            top = np.flatnonzero(begins)
            if not len(top):
                continue
            width = np.add.reduceat(often.astype(np.int64), top)
            i, j = row[top], src_row[top]
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(c[i]), pa.array(inside[top].astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(k[j]), pa.array(r[j]), pa.array(src_lo[top])], ["h", "c", "off", "size", "src_k", "src_r", "src_lo"])

    return run


def repeated_runs(docs: DataFrame, unit: str, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """(k, r, lo, size, src_k, src_r, src_lo): maximal runs of ``size`` windows of a document from unit ``lo`` on that stand more than
    once in the corpus, with the earliest place (least document, then least unit) where the same windows stand.

    docs: the columns of `row_keyed`. A group of copies is one kind; it is never expanded into pairs.
    """
    rows = docs.mapInArrow(K.tidy(_anchor_rows(unit, length, gram)), _ROWS)
    # written first: with an exchange on both sides of the join, Spark can split a hot anchor's rows
    often = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("seen")).where("seen >= 2").select("h"), "often")
    cand = materialise(rows.join(often, "h"), "stretches")
    kinds = cand.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "r", "lo", "n", "at")).alias("one"))
    per = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = materialise(kinds.join(per, "h").select("h", "c", "times", "kinds", "one.*"), "kinds")
    want = kinds.groupBy("k", "r").agg(F.collect_list(F.struct("h", "c", "lo", "n", "at", "times", "kinds")).alias("want"))
    once = docs.join(want, ["k", "r"]).mapInArrow(K.tidy(_bodies(unit, length, hot)), _BODIES)
    bodies = materialise(once, "bodies")
    cold = bodies.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(K.tidy(_runs(unit, length, gram)), _RUNS)
    place = F.struct("k", "r", (F.col("lo") + F.col("off")).alias("lo"))
    windows = bodies.where("hot").select(F.col("body").alias("digest"), "h", "c", "off", "times", place.alias("place"))
    classes = windows.groupBy("digest").agg(F.sum("times").alias("total"), F.min("place").alias("first")).where("total >= 2")
    warm = windows.join(classes, "digest").select("h", "c", "off", F.lit(1).alias("size"), F.col("first.k").alias("src_k"), F.col("first.r").alias("src_r"), F.col("first.lo").alias("src_lo"))
    found = cand.join(cold.unionByName(warm), ["h", "c"])
    return found.select("k", "r", (F.col("lo") + F.col("off")).cast("long").alias("lo"), "size", "src_k", "src_r", "src_lo")
