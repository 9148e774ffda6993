"""Exact self-join of documents by Jaccard similarity of word n-grams, and its components.

Of two sets of similarity s, the first n - ceil(s n) + m grams in any common order (here the order of the hashes) have m in common,
for the smaller m of the two (`margin`). So only documents that share enough first grams are compared:

1. Texts are read once: sizes, digests and first grams of all sets are written. Equal sets are one class (an aggregate of
   digests); only the class's least document goes on.
2. Grams that one document only has among its first are dropped, then documents that are left with fewer grams than any partner
   would share with them, and so on (`peel`). This needs no pairs. The whole sets of what is left are written.
3. A star round: each document is compared with the center of the gram groups that it is in most often: the document of which
   others have the largest share of grams, as they have of the text that near copies are made from. It links most of a group of
   near copies with one comparison a document, so that the trees can prune what is linked. (On 256,410 documents: 8,690 links
   here, 2,100 by the trees.)
4. Documents are held to all their grams: each needs the share ``s`` of its own grams among those of documents that it is not
   linked with, and only its rarest grams beyond that share are groups.
5. Signature trees: each group is built into a tree whose nodes hold OR-combined bitmaps of grams and size ranges. The dual
   traversal drops pairs of nodes that are linked, of sizes too far apart, or whose largest possible overlap is too small; the
   pairs that are left are verified on whole sets. A large group is cut into blocks by size, and only pairs of blocks whose
   size ranges fit are traversed with each other. First only a few of the pairs of each document and of two components are
   verified, in two groups a document, then in all groups, which makes a group of near copies one component without all its
   pairs; then all pairs between what are still different components. With ``rounds=0`` the trees alone find every link.

Grams are compared by 64-bit hashes of their words: two sets of 20,000 different grams share a hash with a chance of 2e-11.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fernwerk.llm import kernels as K
from fernwerk.llm.repeats import NO_ID, by_key, row_keyed
from fernwerk.operators.graph import connected_components
from fernwerk.storage import materialise, release

#: 64-bit words of a bitmap.
BITMAP = 32
#: Documents of a block of a group; blocks of groups beyond 4,000 grow with the root of the group, up to forty times this.
BLOCK = 500
#: Pairs of a document in a task of the first traversal.
SOME = 2
_FAN = 16


def gram_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct gram hashes of each text, and the texts' bounds in them."""
    data, off = K.buffers(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, bounds = K.words(data, off, K.SPACED)
    roll = K.Rolling(K.word_hashes(data, starts, ends))
    count = np.diff(bounds)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at, doc = K.spread(bounds[:-1], size)
    h = roll.of(at, np.minimum(n, count)[doc])
    order = np.argsort(h)
    if batch.num_rows < 1 << 16:  # places of few documents are sorted by radix
        doc = doc.astype(np.uint16)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def margin(n: object) -> object:
    """How many of their first grams two similar sets share at least, by the size of the smaller."""
    return 1 + n // 10


def _lists(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(K.signed(h)))


def _sets(n: int, percent: int) -> Callable:
    """Of each text the size of its set, two digests, and the grams of which a set of at least the similarity must share some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=1 << 20):
            h, bounds = gram_sets(b, n)
            size = np.diff(bounds)
            s = [K.signed(K.Rolling(h, base).of(bounds[:-1], size)) for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
            p = np.where(size > 0, np.minimum(size, size - (percent * size + 99) // 100 + margin(size)), 0)
            at, _ = K.spread(bounds[:-1], p)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("r"), pa.array(size), *map(pa.array, s), _lists(h[at], np.concatenate([[0], np.cumsum(p)]))], ["doc", "r", "n", "s1", "s2", "first"])

    return run


def _whole(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("k"), _lists(*gram_sets(b, n))], ["k", "grams"])

    return run


def arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the bounds of a column of sets."""
    at = col.offsets.to_numpy()
    return col.values.to_numpy().view(np.uint64)[at[0] : at[-1]], at - at[0]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Two sorted distinct arrays whose intersection has ``percent`` hundredths of their union."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    pos = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[pos] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int) -> Callable:
    """Rows sorted by (part, center first) -> links. One center's set is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, center = None, None
        for b in batches:
            h, bounds = arrays(b.column("grams"))
            a, other, parts = (b.column(x).to_pylist() for x in ("a", "b", "part"))
            out = []
            for i in range(len(a)):
                mine = h[bounds[i] : bounds[i + 1]]
                if other[i] is None:
                    part, center = (a[i], parts[i]), mine.copy()
                elif part == (a[i], parts[i]) and linked(center, mine, percent):
                    out.append((a[i], other[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, whole: DataFrame, percent: int, per_part: int = 200) -> DataFrame:
    """The pairs (a, b) that link. The rows of a center are dealt into parts by b, each with the center's set."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("long").alias("parts"))
    pairs = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    centers = many.select(F.col("a").alias("k"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    roles = centers.unionByName(pairs.select(F.col("b").alias("k"), "a", "b", "part"))
    rows = roles.join(whole, "k").select("a", "b", "part", "grams")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(K.tidy(_verify(percent)), "a long, b long")


def bitmaps(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bitmap of each set: BITMAP words a row."""
    out = np.zeros((len(bounds) - 1, BITMAP), np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = h % np.uint64(64 * BITMAP)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, bounds = arrays(b.column("grams"))
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.diff(bounds).astype(np.int64)), pa.array([x.tobytes() for x in bitmaps(h, bounds)], pa.binary())], ["k", "n", "bits"])


class SignatureTree:
    """Documents in order of size, sixteen to a node; a node has the OR of the bitmaps below, the range of sizes, the largest
    excess of a set's size over its bits, and the component if all below have one."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        self.order = np.argsort(size, kind="stable")
        size, bits, comp = size[self.order], bits[self.order], comp[self.order]
        excess = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, excess, comp)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, comp = self.levels[-1]
            at = np.arange(0, len(low), _FAN)
            first, last = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(first == last, first, -1)))


def dual_traversal(s: SignatureTree, t: SignatureTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents (by place in s and t) that the nodes' bounds leave over; of a tree with itself, each pair once."""
    top = max(len(s.levels), len(t.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, u, v = stack.pop()
        if len(u) > (2_000 if level else 50_000):  # of a pair of nodes up to 256 pairs are made
            half = len(u) // 2
            stack += [(level, u[:half], v[:half]), (level, u[half:], v[half:])]
            continue
        a, b = s.levels[min(level, len(s.levels) - 1)], t.levels[min(level, len(t.levels) - 1)]
        ok = (100 * a[2][u] >= percent * b[1][v]) & (100 * b[2][v] >= percent * a[1][u]) & ((a[4][u] != b[4][v]) | (a[4][u] == -1))
        u, v = u[ok], v[ok]
        most = np.bitwise_count(a[0][u] & b[0][v]).sum(1).astype(np.int64) + np.minimum(a[3][u], b[3][v])
        most = np.minimum(most, np.minimum(a[2][u], b[2][v]))
        ok = (100 + percent) * most >= percent * (a[1][u] + b[1][v])
        u, v = u[ok], v[ok]
        if not level:
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield s.order[u], t.order[v]
            continue
        below_u = s.levels[level - 1][1] if level < len(s.levels) else None
        below_v = t.levels[level - 1][1] if level < len(t.levels) else None

        def children(x: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            if below is None:
                return x, np.ones(len(x), np.int64)
            return x * _FAN, np.minimum(len(below) - x * _FAN, _FAN)

        (fu, nu), (fv, nv) = children(u, below_u), children(v, below_v)
        place, owner = K.spread(np.zeros(len(u), np.int64), nu * nv)
        cu, cv = fu[owner] + place // nv[owner], fv[owner] + place % nv[owner]
        if same:
            cu, cv = cu[cu <= cv], cv[cu <= cv]
        if len(cu):
            stack.append((level - 1, cu, cv))


def some_of_each(pairs: np.ndarray, comp: np.ndarray, most: int) -> np.ndarray:
    """Of pairs (two rows of ids, two of their components) those that are among the ``most`` first, by a hash of the pair, of one of
    their documents, and of their two components."""
    a, b = np.sort(pairs, axis=0)
    lot = K.mix(a.astype(np.uint64) * K._C1 ^ b.astype(np.uint64) * K._C2)

    def early(*own: np.ndarray) -> np.ndarray:
        order = np.lexsort((lot, *own))
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in own], axis=0))
        first = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep = np.zeros(len(order), bool)
        keep[order[place < most]] = True
        return keep

    return pairs[:, (early(pairs[0]) | early(pairs[1])) & early(*np.sort(comp, axis=0))]


def _traverse(percent: int, most: int | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "key", 1 << 20):
            key = t["key"].to_numpy()
            k, n, comp, side = (t[x].to_numpy() for x in ("k", "n", "comp", "side"))
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, BITMAP)
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            found: list[np.ndarray] = []
            for lo, hi in zip(cuts, cuts[1:]):
                # side 0: a block with itself; sides 1 and 2: two blocks with each other
                one = lo + np.flatnonzero(side[lo:hi] < 2)
                two = lo + np.flatnonzero(side[lo:hi] == 2)
                same = not len(two)
                if same and (side[lo] or len(one) < 2):
                    continue
                tree = SignatureTree(n[one], bits[one], comp[one])
                other = tree if same else SignatureTree(n[two], bits[two], comp[two])
                for u, v in dual_traversal(tree, other, percent, same):
                    sides = (one[u], (one if same else two)[v])
                    pairs = np.stack([k[x] for x in sides])
                    found.append(some_of_each(pairs, np.stack([comp[x] for x in sides]), most) if most else pairs)
            if found:
                pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def candidate_pairs(groups: DataFrame, marks: DataFrame, percent: int, block: int = BLOCK, most: int | None = None, written: list[DataFrame] | None = None) -> DataFrame:
    """Distinct pairs (a, b) of groups (gram, k, comp) that the signature trees leave over; marks: sizes and bitmaps.

    A group of more than ``block`` documents is cut into bands of sizes so that linked documents are in one band or in neighbours,
    and a band into parts; a task gets one part with itself, or two parts of fitting bands with each other. With ``most``, only so many pairs of a document in a task.
    The table that the result reads is added to ``written``.
    """
    total = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("total")).select("gram", "total", F.least(F.greatest(8 * F.sqrt("total"), F.lit(block)), F.lit(40 * block)).alias("block"))
    width = F.log(F.lit(100.0 / percent)) + 1e-9
    sized = groups.join(total, "gram").join(marks, "k").withColumn("band", F.when(F.col("total") > F.col("block"), F.floor(F.log("n") / width)).otherwise(0).cast("long"))
    sized = materialise(sized, "sized")
    if written is not None:
        written.append(sized)
    parts = sized.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / F.first("block")).cast("long").alias("parts"))
    beside = [parts.select("gram", (F.col("band") + i).alias("band"), F.col("parts").alias(name)) for i, name in ((1, "lower"), (-1, "upper"))]
    known = parts.join(beside[0], ["gram", "band"], "left").join(beside[1], ["gram", "band"], "left").fillna(0, ["lower", "upper"])
    dealt = sized.join(known, ["gram", "band"]).withColumn("part", F.pmod(F.xxhash64("k"), "parts"))

    def cell(band: object, p: object, other: object, q: object, side: int) -> F.Column:
        return F.struct(F.xxhash64("gram", band, p, other, q).alias("key"), F.lit(side).alias("side"))

    def span(first: F.Column, beyond: F.Column) -> F.Column:
        return F.when(first < beyond, F.sequence(first, beyond - 1)).otherwise(F.array().cast("array<long>"))

    zero, band, part = F.lit(0).cast("long"), F.col("band"), F.col("part")
    cells = F.concat(
        F.array(cell(band, part, band, part, 0)),
        F.transform(span(part + 1, F.col("parts")), lambda q: cell(band, part, band, q, 1)),
        F.transform(span(zero, part), lambda q: cell(band, q, band, part, 2)),
        F.transform(span(zero, F.col("upper")), lambda q: cell(band, part, band + 1, q, 1)),
        F.transform(span(zero, F.col("lower")), lambda q: cell(band - 1, q, band, part, 2)),
    )
    rows = dealt.select("k", "n", "comp", "bits", F.explode(cells).alias("c")).select("c.key", "k", "n", "comp", "c.side", "bits")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(K.tidy(_traverse(percent, most)), "a long, b long").distinct()


def peel(met: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Rows (gram, k, n, comp, left) without what no link between components can need: grams of one component, grams of two documents of
    sizes too far apart, and documents with fewer grams left than they would share with their smallest possible partner. ``left`` is how
    many grams a document had left before the last round."""
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10)
    for _ in range(rounds):
        groups = met.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("times"), F.min("n").alias("n0"), F.max("n").alias("n1"))
        mixed = groups.where((F.col("c0") != F.col("c1")) & ((F.col("times") > 2) | (100 * F.col("n0") >= percent * F.col("n1")))).select("gram")
        some = met.join(mixed, "gram")
        full = some.groupBy("k", "n").agg(F.count(F.lit(1)).alias("left")).where(F.col("left") >= least).select("k", "left")
        before, met = met, materialise(some.select("gram", "k", "n", "comp").join(full, "k").select("gram", "k", "n", "comp", "left"), "met")
        release(before)
    return met


def rarest(grams: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Groups (gram, k, comp) from all grams (gram, k) of some documents (k, n, comp): links between components share a gram of them.

    A link of document a shares at least percent hundredths of a's grams, all of them with other components. Of as many grams in
    a common order, here the rarest first, all but that number less one can be left out.
    """
    need = F.ceil(F.col("n") * percent / 100)
    met = grams.join(comp, "k")
    mixed = met.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("times")).where("c0 <> c1").select("gram", "times")
    written = met = materialise(met.join(mixed, "gram"), "mixed")
    full = met.groupBy("k").agg(F.count(F.lit(1)).alias("left"), F.first("n").alias("n")).where(F.col("left") >= need).select("k", "left")
    order = F.row_number().over(Window.partitionBy("k").orderBy("times", "gram"))
    met = met.join(full, "k").withColumn("place", order).where(F.col("place") <= F.col("left") - need + 1)
    out = materialise(met.select("gram", "k", "comp"), "groups")
    release(written)
    return out


def mixed(groups: DataFrame) -> DataFrame:
    """Groups that hold several components."""
    some = groups.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("gram")
    return groups.join(some, "gram").select("gram", "k", "comp")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every document: the size of its set of ``n``-word grams and the least document that it is linked with.

    Documents link when 100 * intersection >= percent * union of their sets of grams of words (runs without ASCII white
    space, A-Z lower-cased). A text of fewer than n words is one gram; a text without words, or a null text, has no
    gram and is linked with nothing. Every row is a document of its own, whatever its id, so rows without an id, or with one id
    and different texts, link by their texts only; a null id counts as the least.
    With ``by_row`` the columns are (k, r, n_shingles, component): rows are named as `row_keyed` names them, and a component has a
    number that no other has, whatever the ids of its rows.
    """
    written: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        written.append(materialise(df, name))
        return written[-1]

    rows = row_keyed(docs, id_col, text_col).withColumnRenamed("k", "doc")
    sets = rows.mapInArrow(K.tidy(_sets(n, percent)), "doc long, r long, n long, s1 long, s2 long, first array<long>")
    sets = write(sets.withColumn("k", F.monotonically_increasing_id()), "sets")
    # what is joined to hot keys is written first: with an exchange on both sides, Spark can split a hot key's rows
    classes = write(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "k")).alias("one"), F.count(F.lit(1)).alias("times")).where("times > 1").select("s1", "s2", "n", F.col("one.k").alias("rep")), "classes")
    copies = write(sets.join(classes, ["s1", "s2", "n"]).select("k", "rep"), "copies")
    grams = sets.select("k", F.explode("first").alias("gram"))
    often = write(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "often")
    known = sets.select("k", "n").join(copies, "k", "left").where("rep is null or rep = k").select("k", "n")
    met = write(grams.join(often, "gram").join(known, "k").select("gram", "k", "n", F.col("k").alias("comp")), "met")
    release(often)
    met = peel(met, percent)
    comp = write(met.groupBy("k").agg(F.first("n").alias("n")).withColumn("comp", F.col("k")), "open")
    names = sets.select("k", "doc", "r").join(comp.select("k"), "k")
    texts = rows.join(names, ["doc", "r"]).dropDuplicates(["doc", "r", "k"]).select("k", "text")
    whole = write(texts.mapInArrow(K.tidy(_whole(n)), "k long, grams array<long>"), "whole")
    links = copies.where("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    for i in range(rounds):
        # the document with the largest share of grams that others have, then the least by a hash, stands for the group
        here = met.drop("comp").join(comp.select("k", "comp"), "k") if i else met
        order = F.xxhash64("k", F.lit(i)) if i else F.struct(-F.col("left") / F.col("n"), F.col("k"))
        center = here.groupBy("gram").agg(F.min_by(F.struct("k", "comp", "n"), order).alias("x"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        center = center.select("gram", F.col("x.k").alias("a"), F.col("x.comp").alias("ca"), F.col("x.n").alias("na"))
        fits = (100 * F.least("n", "na") >= percent * F.greatest("n", "na")) & (F.col("ca") != F.col("comp"))
        pairs = here.join(center, "gram").where(fits).groupBy("k", "n", "na", "a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 1 + F.floor(F.least("n", "na") / 10))
        pairs = pairs.groupBy("k").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
        found = write(verify(pairs.select("a", F.col("k").alias("b")), whole, percent), "star-links")
        links = links.unionByName(found)
        # what a document is linked with names it; these names need not be those of whole components
        own = comp.select(F.col("k").alias("a"), F.col("comp").alias("name"))
        named = found.join(own, "a").groupBy("b").agg(F.min("name").alias("name"))
        comp = write(comp.join(named, comp["k"] == named["b"], "left").select("k", "n", F.coalesce("name", "comp").alias("comp")), "names")
    release(met)
    groups = rarest(whole.select("k", F.explode("grams").alias("gram")), comp, percent)
    written.append(groups)
    marks = write(whole.join(groups.select("k").distinct(), "k").mapInArrow(K.tidy(_signatures), "k long, n long, bits binary"), "marks")
    names = comp.where("k <> comp").select(F.col("k").alias("a"), F.col("comp").alias("b"))
    for few in (True, False):
        now = groups
        if few:  # similar documents likely have one least gram by a hash
            least = [F.min(F.struct(F.xxhash64("gram", F.lit(i)).alias("h"), "gram", "comp")).alias(f"x{i}") for i in range(2)]
            now = groups.groupBy("k").agg(*least).select("k", F.explode(F.array_distinct(F.array("x0.gram", "x1.gram"))).alias("gram"), F.col("x0.comp").alias("comp"))
        some = write(verify(candidate_pairs(mixed(now), marks, percent, most=SOME, written=written), whole, percent), "some-links")
        links = links.unionByName(some)
        # what is linked by now is one component, of which nothing more is compared
        names = write(connected_components(names.unionByName(some)).select(F.col("node").alias("a"), F.col("component").alias("b")), "names")
        groups = write(groups.join(names, groups["k"] == names["a"], "left").select("gram", "k", F.coalesce("b", "comp").alias("comp")), "groups")
    found = write(verify(candidate_pairs(mixed(groups), marks, percent, written=written), whole, percent), "tree-links")
    final = write(connected_components(links.unionByName(found)), "components")
    if by_row:
        out = sets.select("k", "doc", "r", "n").join(final, sets["k"] == final["node"], "left")
        out = materialise(out.select(F.col("doc").alias("k"), "r", F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component")), "linked")
        for table in written:
            release(table)
        return out
    least = final.join(sets.select(F.col("k").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"))
    named = final.join(least, "component").select("node", "least")
    out = sets.select("k", "doc", "n").join(named, sets["k"] == named["node"], "left")
    show = lambda c: F.when(c != NO_ID, c)
    out = materialise(out.select(show(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), show(F.coalesce("least", "doc")).alias("component_id")), "linked")
    for table in written:
        release(table)
    return out
