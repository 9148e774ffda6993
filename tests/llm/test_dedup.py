from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from fernwerk.llm import kernels as K
from fernwerk.llm.ngram_join import SignatureTree, _signatures, _whole, bitmaps, candidate_pairs, dual_traversal, jaccard_components
from fernwerk.llm.repeats import exact_words, longest_previous_factors, lpf_heads, smaller, suffix_order
from fernwerk.llm.substring_dedup import passage_dedup, suffix_array_dedup


def removed(units, length, keep, docs):
    """By comparison of all windows."""
    places = defaultdict(list)
    for i, (d, u) in enumerate(units):
        for j in range(len(u) - length + 1):
            places[u[j : j + length]].append((d, j, i))
    out = []
    for i, (d, u) in enumerate(units):
        gone = [False] * len(u)
        for j in range(len(u) - length + 1):
            others = places[u[j : j + length]]
            hit = {"none": len(others) > 1, "earlier_document": min(others)[0] < d, "first": min(others)[:2] < (d, j)}[keep]
            if hit:
                gone[j : j + length] = [True] * length
        out.append((d, gone))
    return out


@pytest.mark.parametrize("keep", ["none", "earlier_document", "first"])
@pytest.mark.parametrize("length", [40, 200])
def test_byte_strings(frame, corpus, keep, length):
    if keep == "first":
        corpus = corpus[:-1]  # a repeated row has no place of its own
        frame = frame.dropDuplicates(["doc_id"])
    units = [(d, (t or "").encode()) for d, t in corpus]
    want = {d: (len(g), sum(g), sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()) for (d, g), (_, u) in zip(removed(units, length, keep, corpus), units)}
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["kept_sha256"]) for r in suffix_array_dedup(frame, length, keep).collect()}
    assert got == want


@pytest.mark.parametrize("keep", ["none", "earlier_document"])
@pytest.mark.parametrize("length", [10, 50])
def test_passages(frame, corpus, keep, length):
    units = [(d, tuple((t or "").encode().split())) for d, t in corpus]
    want = Counter((d, len(g), sum(g), sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for (d, g), (_, u) in zip(removed(units, length, keep, corpus), units))
    assert Counter((r["doc_id"], r["n_units"], r["n_removed"], r["kept_sha256"]) for r in passage_dedup(frame, length, keep).collect()) == want


def test_hot_anchors_are_dealt_by_content(frame, corpus, monkeypatch):
    """The same result when every anchor with more than one kind counts as hot."""
    from fernwerk.llm import substring_dedup as D

    want = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_array_dedup(frame, 60, "none").collect()}
    plain = D.repeated_runs
    monkeypatch.setattr(D, "repeated_runs", lambda *a: plain(*a, hot=1))
    assert {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_array_dedup(frame, 60, "none").collect()} == want


def test_rewriting_keeps_columns_and_other_texts(frame, corpus):
    out = passage_dedup(frame, 50, rewrite=True)
    assert out.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[4] is None and texts[6] == "  \t\n " and texts[0] == dict(corpus)[0] and texts[1] == ""


def test_null_ids_and_empty_tables(spark, empty):
    text = " ".join(map(str, range(80)))
    rows = spark.createDataFrame([(None, text), (5, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in passage_dedup(rows).collect())
    assert got == [("5", 80), ("None", 0), ("None", 0)]
    for f in (suffix_array_dedup, passage_dedup, jaccard_components):
        assert f(empty).collect() == []


@pytest.mark.parametrize("depth", [1, 5, 8, 20])
def test_suffix_order(depth):
    data = np.random.default_rng(1).integers(97, 99, 200).astype(np.uint8)
    order, levels = suffix_order(data, depth)
    rank = levels[-1][1]
    text = data.tobytes()
    assert all(text[a : a + depth] <= text[b : b + depth] for a, b in zip(order, order[1:]) if max(a, b) + depth <= 200)
    for i in range(200 - depth):
        for j in range(i + 1, 200 - depth):
            assert (rank[i] == rank[j]) == (text[i : i + depth] == text[j : j + depth])


@pytest.mark.parametrize("length", [3, 8, 20, 43])
def test_longest_previous_factors(length):
    rng = np.random.default_rng(length)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    data[150:220] = data[20:90]
    at = np.sort(rng.choice(300 - length, 150, replace=False))
    factor, source = longest_previous_factors(data, at, length)
    text = data.tobytes()
    for i, p in enumerate(at):
        shared = [next((n for n in range(length) if text[p + n] != text[q + n]), length) for q in at[:i]]
        assert factor[i] == max(shared, default=0)
        assert source[i] < 0 if not i or source[i] < 0 else shared[source[i]] == factor[i]
    first = {}
    assert lpf_heads(data, at, length).tolist() == [first.setdefault(text[p : p + length], i) for i, p in enumerate(at)]


@pytest.mark.parametrize("sa", [range(50), range(50, 0, -1), [5, 1, 4, 2, 3, 9, 0, 7]])
def test_smaller_positions(sa):
    sa = np.array(sa)
    p, q = smaller(sa)
    for i, x in enumerate(sa):
        assert p[i] == max((j for j in range(i) if sa[j] < x), default=-1)
        assert q[i] == min((j for j in range(i + 1, len(sa)) if sa[j] < x), default=-1)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    data, off = K.buffers(pa.array(["a bb a ccccccccc bb ccccccccd"]))
    s, e, _ = K.words(data, off, K.SPACED)
    monkeypatch.setattr(K, "word_hashes", lambda *a: np.zeros(6, np.uint64))
    n = exact_words(data, s, e)
    assert n[0] == n[2] and n[1] == n[4] and len(set(n.tolist())) == 4


def test_rows_without_an_id_or_with_one_id_keep_their_texts(spark, words):
    """Row by row against brute force: a text that repeats nowhere loses nothing, whatever its id."""
    import random

    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice(words) for _ in range(90)) for _ in range(3))
    docs = [(None, a), (5, a), (None, b), (7, "short"), (1, c), (1, a), (1, None), (9, f"{c} end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    low = [(-1 if d is None else d, t) for d, t in docs]
    for length, f, keep, unit in ((200, suffix_array_dedup, "none", lambda t: t.encode()), (50, passage_dedup, "earlier_document", lambda t: tuple(t.encode().split()))):
        want = Counter((d if d >= 0 else None, len(g), sum(g)) for d, g in removed([(d, unit(t or "")) for d, t in low], length, keep, low))
        assert Counter((r["doc_id"], r["n_units"], r["n_removed"]) for r in f(df, length, keep).collect()) == want
    texts = Counter(tuple(r) for r in passage_dedup(df, 50, rewrite=True).collect())
    assert texts[(None, b)] == texts[(None, a)] == texts[(1, c)] == texts[(1, None)] == 1 and texts[(5, "")] == 1


def test_very_long_texts(spark, words):
    import random

    rng = random.Random(6)
    long = " ".join(rng.choice(words) for _ in range(20_000))
    docs = [(1, long), (2, f"x {long[50_000:]}"), (3, long[:400])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for length, f, keep, unit in ((200, suffix_array_dedup, "none", lambda t: t.encode()), (50, passage_dedup, "earlier_document", lambda t: tuple(t.encode().split()))):
        want = {d: (len(g), sum(g)) for d, g in removed([(d, unit(t)) for d, t in docs], length, keep, docs)}
        assert {r["doc_id"]: (r["n_units"], r["n_removed"]) for r in f(df, length, keep).collect()} == want


def gram_set(text, n=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, percent, n=5):
    sets = [(d, gram_set(t, n)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize(("percent", "n"), [(80, 5), (50, 3)])
def test_jaccard_components(frame, corpus, percent, n):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame, n, percent).collect()}
    assert got == components(corpus, percent, n)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_chains_of_near_copies(spark, words, rounds):
    """Each text differs by some words from the one before: only neighbours link. The trees alone find them too."""
    import random

    rng = random.Random(2)
    now, docs = [rng.choice(words) for _ in range(100)], []
    for i in range(25):
        docs.append((i * 3 % 25, " ".join(now)))
        now = [*now[3:], *(rng.choice(words) for _ in range(3))]
    docs += [(100 + i, f"{docs[0][1]} {' '.join(rng.choice(words) for _ in range(60))}") for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, rounds=rounds).collect()}
    assert got == components(docs, 80)


def test_blocks_of_a_large_group_lose_no_pair(spark, words):
    import random

    rng = random.Random(4)
    base = [rng.choice(words) for _ in range(60)]
    docs = []
    for i in range(30):
        t = list(base)
        t[rng.randrange(60)] = f"w{i}"
        docs.append((i, " ".join(t)))
    docs += [(100 + i, " ".join([*docs[i][1].split(), *(f"v{i}-{j}" for j in range(8))])) for i in range(10)]
    groups = spark.createDataFrame([(1, i, i) for i, _ in docs], "gram long, k long, comp long")
    texts = spark.createDataFrame(docs, "k long, text string").repartition(1)
    whole = texts.mapInArrow(_whole(5), "k long, grams array<long>").mapInArrow(_signatures, "k long, n long, bits binary")
    one = {tuple(r) for r in candidate_pairs(groups, whole, 80).collect()}
    assert {tuple(r) for r in candidate_pairs(groups, whole, 80, block=4).collect()} == one
    sets = {i: gram_set(t) for i, t in docs}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= one


def test_trees_drop_no_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(300):
        if sets and rng.random() < 0.5:
            s = sets[rng.integers(len(sets))].copy()
            s[: rng.integers(1, 12)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        else:
            s = rng.integers(0, 2**63, rng.integers(5, 80), dtype=np.uint64)
        sets.append(np.unique(s))
    bounds = np.cumsum([0, *map(len, sets)])
    tree = SignatureTree(np.diff(bounds), bitmaps(np.concatenate(sets), bounds), np.arange(300))
    found = {(int(a), int(b)) for u, v in dual_traversal(tree, tree, 80, True) for a, b in zip(np.minimum(u, v), np.maximum(u, v))}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= found and len(found) < 300 * 299 / 4


def test_word_kernels():
    texts = ["a bb  ccc", None, "", "été x", "y" * 40]
    data, off = K.buffers(pa.array(texts))
    s, e, b = K.words(data, off, K.SPACED)
    assert [[data[x:y].tobytes() for x, y in zip(s[i:j], e[i:j])] for i, j in zip(b, b[1:])] == [(t or "").encode().split() for t in texts]
    assert K.sliding_min(np.array([5, 3, 4, 9, 1, 7]), 3).tolist() == [3, 3, 1, 1]
