import struct
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fernwerk.llm import queries as Q
from fernwerk.llm.bpe import bpe_round_trip, ids_array
from fernwerk.llm.decontaminate import brute_force, contamination, decontaminate, items_digest
from fernwerk.llm.langid import identify
from fernwerk.llm.toxicity import Lexicon, Matcher, fold, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


HARD = ["I'll don't we've 's 'S", "<|endoftext|>a<|startoftext|> <|endoftext", "aaaaaaaaaaaaaaaaaaaa bbbbbb", "x" * 5000, "１２３ ½ ٣", "é Å ﬁ", "ΟΔΟΣ Σ", "İstanbul", "\u0085 a\x1cb\x00c", "日本語テキスト", "!!!???***%%%&&&", "hello,world_foo-bar", "👩‍👩‍👧"]


def test_bpe_against_the_library(spark, frame, corpus, library):
    docs = [*corpus[:-1], *((1000 + i, t) for i, t in enumerate(HARD))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe_round_trip(df, Q.vocabulary()).collect()}
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert ids_array(rows[d]["ids"]) == ids, t
        assert rows[d]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert rows[d]["n_tokens"] == len(ids)


def test_bpe_query_on_all_documents(spark, library):
    rows = {r["doc_id"]: r for r in Q.op2_bpe_round_trip(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[d]["ids_sha256"] == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_bpe_of_nothing(empty):
    assert bpe_round_trip(empty, Q.vocabulary()).collect() == []


BENCH = [("b1", "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("b2", "short item"), ("b3", "!!"), ("b4", None), ("b5", "Alpha beta gamma delta epsilon zeta eta theta"), (None, "eins zwei drei"), ("b2", "another row")]
LEAKS = [(1, "see ALPHA, beta; gamma delta epsilon zeta eta theta!"), (2, "a short item and alpha beta gamma"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta"), (6, "short, item short item"), (7, "eins-zwei-drei short item"), (8, "shortitem")]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(spark, block):
    df = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("items", F.lit(1))
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    rows = contamination(df, bench, 8, block_bytes=block).select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), items_digest().alias("d")).collect()
    want = brute_force(LEAKS, [("" if i is None else i, t or "") for i, t in BENCH])
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n"], r["d"], r["n"] >= 2) for r in rows} == want


def test_decontaminate_cuts_and_rejects(spark):
    df = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumn("c1", F.lit("clash"))
    out = {r["doc_id"]: r["text"] for r in decontaminate(df, spark.createDataFrame(BENCH, "item_id string, text string")).collect()}
    assert 1 not in out and 7 not in out  # two items each
    assert out[2] == "a  and alpha beta gamma" and out[3] is None and out[8] == "shortitem" and out[5] == LEAKS[4][1]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_rows_repeated_with_one_id_keep_their_own_hits(spark, block):
    leaks = [(i % 2 or None, t) for i, (_, t) in enumerate(LEAKS)] + [(1, LEAKS[0][1])]
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    rows = contamination(spark.createDataFrame(leaks, "doc_id long, text string"), bench, 8, block_bytes=block).collect()
    want = [(d, *brute_force([(d, t)], [("" if i is None else i, x or "") for i, x in BENCH])[d][:3]) for d, t in leaks]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in rows), key=repr) == sorted(want, key=repr)


def test_decontaminate_in_blocks_equals_one_block(spark):
    df = spark.createDataFrame([(i % 3 or None, t) for i, t in LEAKS + LEAKS[:3]], "doc_id long, text string").withColumn("d", F.lit("clash"))
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    one, many = (sorted((tuple(r) for r in decontaminate(df, bench, block_bytes=b).collect()), key=repr) for b in (1 << 20, 20))
    assert one == many and len(one) < 11


def test_contamination_of_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert contamination(empty, none).collect() == []
    df = spark.createDataFrame(LEAKS, "doc_id long, text string")
    assert {r["n_hit"] for r in contamination(df, none).collect()} == {0}


def test_op4_query(spark):
    rows = {r["doc_id"]: tuple(r)[1:] for r in Q.op4_decontamination(spark, SF).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows == brute_force(docs, bench)


def test_folding_and_exceptions():
    assert fold("IDI0T іdіоt 1d1ot") == "idiot idiot idiot"
    assert fold("ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭 ídíot i\u0336d\u0336iot Ïdïöt ıdiot 1\u200bdiot") == "idiot idiot idiot idiot idiot idiot idiot"
    m = Matcher(Lexicon({"idiot": 5.0}, {"lowei": 4.0}, {"no idiot"}, (-2.0, 2.0, 0.0)))
    assert m.score("you 1D10T") > 0.5 > m.score("no idiot here") and m.score("xidiot idiots") < 0.5
    assert m.score(f"no {'-' * 300} idiot") < 0.5 < m.score(f"{'no ' * 100}! you idiot")
    assert m.score("der loweischaft") > 0.5 > m.score("der flowei") and m.score("") == m.score("clean")


def test_toxicity_learns_words_and_stems(spark, words):
    import random

    rng = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            t[7] = rng.choice(["scum", "l0wei" + rng.choice(words)])
        docs.append((i, " ".join(t), "x"))
        labels.append((i, int(i % 5 == 0)))
    docs += [(900, None, "x"), (901, "", "x"), (902, "SCUM", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(df, lab, "id % 3 <> 1").collect()}
    held = [i for i in range(300) if i % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[902] >= 0.5 > got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    kept = toxicity(df, lab, keep=True)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 303


def test_toxicity_without_labels(spark, frame, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(frame, none).collect()} == {0.5}
    assert toxicity(empty, none).collect() == []


def test_op5_held_out(spark):
    rows = Q.op5_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)


def test_language_by_code_length(spark):
    en, de = "the house and the garden that they have seen with their own eyes ", "das haus und der garten den sie mit ihren eigenen augen gesehen haben "
    docs = [(i, (en if i % 2 else de)[i % 9 :] * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    docs += [(100, None, "en"), (101, "12 !! --", "de"), (102, "", None), (103, "und der", None), (104, "Ж", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, "id % 3 <> 1").collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[104][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_without_training_rows(spark, frame, empty):
    assert {r["lang_pred"] for r in identify(frame, "false").collect()} == {"und"}
    assert identify(empty).collect() == []


def test_op6_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = Q.op6_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


def test_code_lengths_are_those_of_the_trees():
    """Table entries against a plain recursion over counts."""
    import math

    import numpy as np
    import pyarrow as pa

    from fernwerk.llm.langid import START, _count, code_lengths, model

    train = pa.RecordBatch.from_pydict({"text": ["abracadabra", "cabbage bab", "\0é\0"], "lang": ["x", "x", "x"]})
    grams = pa.Table.from_batches(_count(iter([train])))
    trees = model(["x"], np.zeros(grams.num_rows, int), grams["gram"].to_numpy(), grams["n"].to_numpy())
    ctx = [{} for _ in range(4)]
    for t in train.column("text").to_pylist():
        b = (START,) * 3 + tuple(t.encode())
        for i in range(3, len(b)):
            for k in range(4):
                ctx[k].setdefault(b[i - k : i], Counter())[b[i]] += 1

    def cost(history, s):
        bits = 0.0
        for k in (3, 2, 1, 0):
            c = ctx[k].get(history[len(history) - k :] if k else ())
            if c is None:
                continue
            total = sum(c.values()) + len(c)
            if c[s]:
                return bits - math.log2(c[s] / total)
            bits -= math.log2(len(c) / total)
        return bits + 8

    texts = ["abbab cab", "", "\0é", "Ж", "abracadabra" * 50]
    bits, _ = code_lengths(trees, pa.RecordBatch.from_pydict({"text": texts}))
    for got, t in zip(bits[:, 0], texts):
        b = (START,) * 3 + tuple(t.encode())
        assert got == pytest.approx(sum(cost(b[i - 3 : i], b[i]) for i in range(3, len(b))), rel=1e-5)


def test_tables_find_what_they_hold():
    import numpy as np

    from fernwerk.llm.langid import Table

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 36, 5000))
    t = Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + (1 << 37)) == -1).all()
    assert (Table(keys[:0]).find(keys[:5]) == -1).all()


def test_sampled_ids_are_the_first_of_each_language_by_hash(spark):
    from fernwerk.llm.langid import sampled

    rows = [(i, "big" if i % 10 else "small") for i in range(6000)]
    got = {r[0] for r in sampled(spark.createDataFrame(rows, "id long, lang string"), 40).collect()}
    at = {r[0]: r[1] for r in spark.range(6000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).collect()}
    want = {i for lang in ("big", "small") for i in sorted((i for i, x in rows if x == lang), key=at.get)[:40]}
    assert got == want


def test_tokens_that_end_at_a_place_are_all_suffixes_in_the_vocabulary():
    """What the suffix links of a suffix automaton of the vocabulary give: longest first."""
    import random

    from fernwerk.llm.bpe import load

    with open(Q.vocabulary(), encoding="utf-8") as f:
        bpe = load(f.read())
    tokens = {}
    for i, t in bpe.names.items():
        if i in bpe.length:
            tokens[bpe._symbols(t)] = i
    rng = random.Random(3)
    most = max(map(len, tokens))
    for _ in range(200):
        text = "".join(rng.choice(list(tokens)) for _ in range(4))
        want = [(end, tokens[text[b : end + 1]]) for end in range(len(text)) for b in range(max(0, end + 1 - most), end + 1) if text[b : end + 1] in tokens]
        assert list(bpe.ends.iter(text)) == want
