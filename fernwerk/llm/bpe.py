"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word has exactly one last token. It is found among the tokens that end there as the one that can follow the last token of the prefix before it: a pair of tokens is
compatible if no merge across their border would run before the merges that build them. Back-pointers give the ids.
The cost is linear in the word, whatever its length.

The tokens that end at a place are the suffixes of the text read so far that are in the vocabulary. A suffix automaton of the
vocabulary would give them by its suffix links, from the longest match downwards; the Aho-Corasick automaton here is its part that
is reached by prefixes of tokens, and its failure links are those suffix links restricted to it, so both walk through the same
tokens in the same order, the longest first (`tests/llm/test_text.py` compares them with a search of all suffixes).
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fernwerk.llm import kernels as K

_END = "</w>"
_LAST = 0x1000  # a word's last symbol is the byte's character plus this
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [at[b] for b in range(256)]


class PrefixBPE:
    """Encoder and decoder of a word-level BPE file (lower case, word ends, white space dropped)."""

    def __init__(self, spec: dict, cache: int = 150_000):
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or spec["decoder"] is not None:
            raise ValueError("only word-end BPE without a decoder is supported")
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        symbols = {t: self._symbols(t) for t in model["vocab"]}
        id_of = model["vocab"]
        self.length = {id_of[t]: len(s) for t, s in symbols.items()}
        self.rank = dict.fromkeys(self.names, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (id_of[a], id_of[b]), id_of[a + b]
            self.merge[pair], self.rank[made], self.halves[made] = r, r, pair
        self.ends = ahocorasick.Automaton()
        for t, s in symbols.items():
            self.ends.add_word(s, id_of[t])
        self.ends.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # the pattern and the normalisers of the file, with the white space of Unicode
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.bytes = byte_characters()
        self.fits: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.words = _Words(self, cache)
        self.table = [self.names.get(i, "") for i in range(max(self.names) + 1)]

    @staticmethod
    def _symbols(token: str) -> str:
        if token.endswith(_END) and len(token) > len(_END):
            body = token[: -len(_END)]
            return body[:-1] + chr(ord(body[-1]) + _LAST)
        return token

    def _apart(self, a: int, b: int, above_a: int, above_b: int) -> bool:
        """No merge across the border of a and b comes before the merges above them; walks both edges back in time."""
        while True:
            r = self.merge.get((a, b))
            if r is not None and r < above_a and r <= above_b:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if rb >= ra:
                if rb < 0:
                    return True
                above_b, b = rb, self.halves[b][0]
            else:
                above_a, a = ra, self.halves[a][1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a followed by that of b is encoded as a, b."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            got = self.fits[a, b] = self._apart(a, b, _NEVER, _NEVER)
        return got

    def reachable(self, t: int) -> bool:
        """Whether the text of t is encoded as t."""
        got = self.sound.get(t)
        if got is None:
            r = self.rank[t]
            got = self.sound[t] = r < 0 or (all(map(self.reachable, self.halves[t])) and self._apart(*self.halves[t], r, r - 1))
        return got

    def encode_word(self, word: str) -> list[int]:
        chars = [self.bytes[b] for b in word.encode()]
        chars[-1] = chr(ord(chars[-1]) + _LAST)
        last: list[int] = [-1] * (len(chars) + 1)
        for end, t in self.ends.iter("".join(chars)):
            at = end + 1 - self.length[t]
            if last[end + 1] < 0 and self.reachable(t) and (at == 0 or (last[at] >= 0 and self.compatible(last[at], t))):
                last[end + 1] = t
        ids, i = [], len(chars)
        while i:
            ids.append(last[i])
            i -= self.length[last[i]]
        return ids[::-1]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself: no final sigma
                text = text.replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.find(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._plain(p) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words(dict):
    """Encoded words; forgets all when full, and never keeps very long ones."""

    def __init__(self, bpe: PrefixBPE, size: int):
        self.bpe, self.size = bpe, size

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.encode_word(word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[word] = out
        return out


@lru_cache(2)
def load(spec: str) -> PrefixBPE:
    return PrefixBPE(json.loads(spec))


def _coder(spec: object, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for b in K.chunks(batches, text_col, 4 << 20):
            ids = [bpe.encode(x or "") for x in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(c for n, c in zip(b.schema.names, b.columns) if n != text_col), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                [*(n for n in b.schema.names if n != text_col), "_ids", "_n", "_decoded"],
            )

    return run


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text with the vocabulary file at ``path`` and decodes the ids again.

    Returns the id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded. A null or empty text has
    no ids. Row order, repeated rows and ids have no influence; other columns are not read. No shuffle. The file is
    read on the driver and broadcast: a vocabulary has a few MB.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(K.tidy(_coder(spec, "text")), f"id {kind}, _ids binary, _n long, _decoded string")
    return out.select(F.col("id").alias(id_col), F.col("_n").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"))


def ids_array(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
