"""Removal of repeated byte strings (suffix order) and of repeated word passages (seed and extend)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernwerk.llm import kernels as K
from fernwerk.llm.repeats import NO_ID, repeated_runs, row_keyed, units


def _removals(docs: DataFrame, unit: str, length: int, gram: int, keep: str) -> DataFrame:
    """(k, r, text, cut): documents with the runs of windows to cut, at most one entry a stretch of the document."""
    runs = repeated_runs(docs, unit, length, gram)
    if keep == "earlier_document":
        runs = runs.where("src_k < k")
    elif keep == "first":
        runs = runs.where("named_struct('k', src_k, 'r', src_r, 'lo', src_lo) < named_struct('k', k, 'r', r, 'lo', lo)")
    elif keep != "none":
        raise ValueError(f"keep: {keep}")
    return docs.join(runs.groupBy("k", "r").agg(F.collect_list(F.struct("lo", "size")).alias("cut")), ["k", "r"], "left")


def _apply(unit: str, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, max_bytes=2 << 20):
            data, _, bounds, _, _ = units(b, unit)
            lists = b.column("cut")
            if lists.null_count < len(lists):
                flat = lists.flatten()
                at = lists.offsets.to_numpy()
                doc = np.repeat(np.arange(len(lists)), np.diff(at))
                lo = bounds[doc] + flat.field("lo").to_numpy()
                hi = np.minimum(lo + flat.field("size").to_numpy() + length - 1, bounds[doc + 1])
                gone = K.cover(lo[lo < hi], hi[lo < hi], int(bounds[-1]))
            else:
                gone = np.zeros(int(bounds[-1]), bool)
            count = np.concatenate([[0], np.cumsum(gone)])
            removed = count[bounds[1:]] - count[bounds[:-1]]
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            full = bounds[:-1][bounds[:-1] < bounds[1:]]
            begin[full] = gone[full]
            spans = np.concatenate([[0], np.cumsum(begin)])
            spans = spans[bounds[1:]] - spans[bounds[:-1]]
            kept, null = [], b.column("text").is_null().to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist() if unit == "word" else None
            for i in range(b.num_rows):
                s, e = int(bounds[i]), int(bounds[i + 1])
                if unit == "byte":
                    kept.append((data[s:e][~gone[s:e]] if removed[i] else data[s:e]).tobytes())
                elif removed[i]:
                    w = texts[i].split()
                    kept.append(b" ".join([w[j] for j in np.flatnonzero(~gone[s:e])]))
                else:
                    kept.append(b" ".join((texts[i] or b"").split()))
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("r"), pa.array(np.diff(bounds)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([None if z else x for x, z in zip(kept, null)], pa.binary()), pa.array([sha256(x).hexdigest() for x in kept])],
                ["k", "r", "n_units", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


_OUT = "k long, r long, n_units long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _dedup(docs: DataFrame, unit: str, length: int, gram: int, keep: str, id_col: str, text_col: str) -> DataFrame:
    out = _removals(row_keyed(docs, id_col, text_col), unit, length, gram, keep).mapInArrow(K.tidy(_apply(unit, length)), _OUT)
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias(id_col), "n_units", "n_removed", "n_spans", "kept", "kept_sha256")


def _rewrite(docs: DataFrame, length: int, gram: int, keep: str, id_col: str, text_col: str) -> DataFrame:
    """All columns of the documents, cut texts rewritten: only texts that change are joined to the rest."""
    rows = row_keyed(docs, id_col, text_col)
    cut = _removals(rows, "word", length, gram, keep).where("cut is not null").mapInArrow(K.tidy(_apply("word", length)), _OUT)
    cut = cut.select(F.col("k").alias("_k"), F.col("r").alias("_r"), F.decode("kept", "UTF-8").alias("_kept")).dropDuplicates(["_k", "_r"])
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    key = F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(NO_ID))
    same = (key == F.col("_k")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_r"))
    return plain.join(cut, same, "left").withColumn(text, F.coalesce("_kept", text)).select(*names).toDF(*docs.columns)


def suffix_array_dedup(docs: DataFrame, length: int = 200, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts byte strings of ``length`` bytes that repeat within or across documents.

    keep "first": the earliest copy (least id, then least byte) stays, as the longest-previous-factor array has it;
    "none": every copy goes; "earlier_document": only copies of a string of a document with a smaller id go.
    Strings are judged on the input. Returns id, n_units (bytes), n_removed, n_spans, kept (binary: a cut may fall
    inside a character; null for a null text), kept_sha256. Null, empty and short texts are returned whole. Rows
    are named by id and text: rows without an id, or with the id of another, keep their own texts, and rows repeated
    with both get one result each. A null id counts as the least id, of rows with one id that with the least hash of the text.

    Bytes meet in bounded chunks with a suffix array and its longest-previous-factor array (`repeats.lpf_heads`).
    """
    return _dedup(docs, "byte", length, max(1, length * 8 // 25), keep, id_col, text_col)


def passage_dedup(docs: DataFrame, length: int = 50, keep: str = "earlier_document", id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """Cuts passages of ``length`` words that repeat: documents meet on winnowed seeds, which are extended to both sides
    word by word (`repeats.extended_heads`); maximal repeats of at least the length are cut.

    Same options, result and edge cases as `suffix_array_dedup`, in words; kept joins the kept words by one space.
    With ``rewrite`` the documents themselves are returned, all columns: texts that lost words are replaced by what is kept.
    """
    if rewrite:
        return _rewrite(docs, length, max(1, length * 2 // 5), keep, id_col, text_col)
    return _dedup(docs, "word", length, max(1, length * 2 // 5), keep, id_col, text_col)
