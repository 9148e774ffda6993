import hashlib
from pathlib import Path

import corpus_pipeline as P
from fernwerk.llm.decontaminate import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in P.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert len(P.STAGES) == 5
    for d in seen[1:-1]:
        assert d.columns == columns
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 0.5 * len(ids[0])
    assert seen[-1].count() == len(ids[-1])
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [tuple(r) for r in seen[4].select("doc_id", "text").collect()]
    assert sum(v[1] for v in brute_force(texts, bench).values()) == 0
    passages, copies = set(), 0
    for _, t in sorted(tuple(r) for r in seen[3].select("doc_id", "text").collect()):
        w = (t or "").split(" ")
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        copies += len(own & passages)
        passages |= own
    assert copies == 0


def test_run_equals_its_stages(spark):
    out = P.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids"} and out.count() > 0


def test_unlike_documents_without_an_id_or_with_one_id_stay(spark):
    words = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcde"]
    rows = [(None, words[0]), (None, words[1]), (3, words[1]), (4, words[2]), (4, words[3]), (5, words[4]), (6, words[4] + " more"), (7, None), (7, None), (8, words[3])]
    got = P.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    want = [(None, words[0]), (None, words[1]), (4, words[2]), (4, words[3]), (5, words[4]), (7, None), (7, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_near_copies_are_found_without_a_copy_of_the_texts(spark):
    """What the stage leaves in the shared folder is far smaller than the texts that it read."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "fernwerk"
    size = lambda: sum(x.stat().st_size for x in shared.rglob("*.parquet") if x.is_file())
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), size()
    assert 0 < P.keep_one_of_near_copies(spark, docs, SF).count() < docs.count()
    assert size() - before < 0.2 * Path(f"{SF}/documents.parquet").stat().st_size


def test_of_equal_ids_the_least_digest_stays_and_of_equal_rows_one(spark):
    a, b, c = (" ".join([*(f"{p}{i}" for i in range(40)), "end"]) for p in "xyz")
    near = [f"{a} {w}" for w in ("one", "two", "three")]
    rows = [(5, t, "en") for t in near] + [(5, b, "en"), (9, f"{b} more", "en"), (5, c, "en"), (5, c, "de"), (None, c.upper(), "en"), (7, " \t", "en"), (7, " \t", "en")]
    got = P.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), SF).collect()
    want = [(5, min(near, key=lambda t: hashlib.sha256(t.encode()).hexdigest()), "en"), (5, b, "en"), (None, c.upper(), "en"), (7, " \t", "en"), (7, " \t", "en")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_stages_on_nulls_empties_repeats_and_nothing(spark):
    """Every stage keeps rows with null and empty texts, repeated rows and clashing columns; an empty table stays empty."""
    words = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    rows = [(None, None), (1, None), (2, ""), (3, " "), (4, words[0]), (4, words[1]), (None, words[2]), (5, "x " * 20_000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, k string, r string, h string, _row string, score string, items string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdef") for i, t in rows], kind)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns, name
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(rows, key=repr), name
        assert stage(spark, df.limit(0), SF).collect() == [], name
    ids = [(r["doc_id"], r["n_tokens"]) for r in P.encode(spark, df, SF).collect()]
    assert {(None, 0), (1, 0), (2, 0), (3, 0)} <= set(ids) and len(ids) == 8
    assert P.encode(spark, df.limit(0), SF).collect() == []
