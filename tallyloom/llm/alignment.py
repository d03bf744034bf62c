"""Alignment of two tokenizers over the same bytes: which tokens overlap, end together, and share a group.

A text, a space before it, is encoded by a byte-level model (A) and by a piece model (B). Both sequences of tokens
cover the same bytes, so each is a sparse matrix of tokens by bytes, in compressed rows (``Csr``). The product A x B^T, row by
row as Gustavson has it, holds for every pair of tokens the bytes they share: the overlap links. Links whose byte ranges end together
cut the text into groups; the matrices of tokens by groups give, by the same product, the pairs of tokens that share a group.
The matrices of many texts are put together as blocks of one, so a task multiplies a megabyte of text at once.

How often an id pair is linked is counted over the corpus. The table of the counts is bounded by the vocabularies: linked tokens end
together, so one is a suffix of the other, and there are no more such pairs than the tokens have suffixes that are tokens (some 10^6). It is
joined to the pairs of every text, which were written before and are not encoded again.

The vocabulary files are read once and travel with the tasks (some megabytes); executors need no copy of them.

Edge cases: a null or empty text has no tokens, likewise one whose tokens do not spell it (the piece model reads U+2581 as a
space, for example); strings of special tokens are plain text; equal rows get equal results and count each; no rows give no
rows; further columns pass through, one named like an added one is replaced.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.arrow import give_back, small_batches
from tallyloom.llm.common import broadcast_below
from tallyloom.plans.small import materialize

CHUNK_BYTES = 1024 * 1024
#: Fixed value: how the byte-level model cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that the fast encoder's pattern has no stack for; such texts go to the other one, with the same ids.
_LONG_SPACE = re.compile(r"\s{2000}")
ALIGNED = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_shared": "bigint", "groups": "string",
           "pairs": "array<struct<a:int,b:int,n:int>>"}
_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in ALIGNED.items()) + ">"


# ------------------------------------------------------------------------ sparse matrices

@dataclass
class Csr:
    """A sparse 0/1 matrix: row i has ones in the columns ``indices[indptr[i]:indptr[i + 1]]``."""
    indptr: np.ndarray
    indices: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transpose(self) -> Csr:
        """Entries counted per column, and placed there in the order of their rows."""
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.n_cols))])
        return Csr(indptr, self.rows()[np.argsort(self.indices, kind="stable")], self.n_rows)

    def slice(self, start: int, stop: int) -> Csr:
        """Some of the rows."""
        ends = self.indptr[start:stop + 1]
        return Csr(ends - ends[0], self.indices[ends[0]:ends[-1]], self.n_cols)


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def multiply(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product by rows: every entry (i, k) of ``a`` adds row k of ``b`` to row i. Rows, columns and values of what is not zero,
    by row and column."""
    reach = np.diff(b.indptr)[a.indices]
    rows = np.repeat(a.rows(), reach)
    columns = b.indices[np.repeat(b.indptr[a.indices], reach) + ramp(reach)]
    key = rows * b.n_cols + columns
    if len(key) and (key[1:] < key[:-1]).any():
        key.sort(kind="stable")
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new] // max(1, b.n_cols), key[new] % max(1, b.n_cols), np.diff(np.append(new, len(key)))


def covering(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens of these lengths one after the other."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(ends, np.arange(ends[-1]), int(ends[-1]))


def belonging(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups, for tokens that belong to one group each."""
    return Csr(np.arange(len(group) + 1), group, groups)


# ------------------------------------------------------------------------ tokens of one task

@dataclass(frozen=True)
class Vocabularies:
    """The contents of the two vocabulary files."""
    byte_model: bytes
    piece_model: bytes


def load_vocabularies(byte_file: str, piece_file: str) -> Vocabularies:
    with open(byte_file, "rb") as a, open(piece_file, "rb") as b:
        return Vocabularies(a.read(), b.read())


def byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write for the 256 bytes: printable ones for themselves, the others in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        import sentencepiece
        import tiktoken
        model = json.loads(vocabularies.byte_model)["model"]
        signs, vocab = byte_signs(), model["vocab"]
        spelled = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else None for t, i in vocab.items()}
        #: Ids of merged tokens ascend with the rank of the merge, so the ids are the ranks.
        ranks = {spelled[i]: i for i in range(256 + len(model["merges"]))}
        self.a_bytes = [spelled.get(i) or b"" for i in range(max(vocab.values()) + 1)]
        self.fast = tiktoken.Encoding("byte model", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.byte_model, self.slow = vocabularies.byte_model, None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.piece_model)
        n = self.pieces.get_piece_size()
        self.b_bytes = [bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i)
                        else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        #: An id and what follows it: within and at the end of a group's A tokens, within and at the end of its B tokens.
        self.written = [f"{i}{s}" for s in ",|" for i in range(len(self.a_bytes))] + [f"{i}{s}" for s in ",;" for i in range(n)]

    def encode_a(self, text: str) -> list[int]:
        if not _LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_buffer(self.byte_model)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for every text; none where they do not spell the text."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else ()):
            a, want = self.encode_a(f" {text}"), b" " + text.encode()
            same = (text and b"".join(map(self.a_bytes.__getitem__, a)) == want
                    and b"".join(map(self.b_bytes.__getitem__, b)) == want)
            out.append((a, b) if same else ([], []))
        return out


@lru_cache(maxsize=2)
def _encoders(vocabularies: Vocabularies) -> Encoders:
    return Encoders(vocabularies)


class Aligned:
    """The tokens of some texts one after the other, their matrices and links. Token numbers count over all texts."""

    def __init__(self, encoders: Encoders, texts: list[str]) -> None:
        encoded = encoders.encode(texts)
        self.a_counts = np.array([len(a) for a, _ in encoded], np.int64)
        self.b_counts = np.array([len(b) for _, b in encoded], np.int64)
        self.a = np.array([i for a, _ in encoded for i in a], np.int64)
        self.b = np.array([i for _, b in encoded for i in b], np.int64)
        by_byte_a, by_byte_b = covering(encoders.a_lengths[self.a]), covering(encoders.b_lengths[self.b])
        #: Overlap links: numbers of an A and a B token and the bytes they share.
        self.overlaps = multiply(by_byte_a, by_byte_b.transpose())
        a_ends, b_ends = by_byte_a.indptr[1:], by_byte_b.indptr[1:]
        together = a_ends[self.overlaps[0]] == b_ends[self.overlaps[1]]
        #: Links of tokens that end together; each closes a group.
        self.link_a, self.link_b = self.overlaps[0][together], self.overlaps[1][together]
        cuts = a_ends[self.link_a]
        self.groups_a = belonging(np.searchsorted(cuts, a_ends), len(cuts))
        self.groups_b = belonging(np.searchsorted(cuts, b_ends), len(cuts))

    def text_of(self, side: str, tokens: np.ndarray) -> np.ndarray:
        """The text that each token belongs to."""
        return np.searchsorted(np.cumsum(getattr(self, f"{side}_counts")), tokens, side="right")

    def shared(self, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of tokens that share a group, for some A tokens at a time."""
        members = self.groups_b.transpose()
        for start in range(0, len(self.a), rows):
            a, b, _ = multiply(self.groups_a.slice(start, start + rows), members)
            yield a + start, b


def _aligned(texts: pa.Array, encoders: Encoders) -> Iterator[tuple[int, Aligned]]:
    """Chunks of the texts, with the number of the first; null as empty."""
    chunk, size, first = [], 0, 0
    for k, text in enumerate(texts):
        chunk.append(text.as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield first, Aligned(encoders, chunk)
            chunk, size, first = [], 0, k + 1
    if chunk:
        yield first, Aligned(encoders, chunk)


def _written_groups(x: Aligned, encoders: Encoders) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for every text: the ids of its groups in order."""
    group_a, group_b = x.groups_a.indices, x.groups_b.indices
    n, total = len(encoders.a_bytes), np.zeros(len(x.a) + len(x.b), np.int64)
    before_b = np.concatenate([[0], x.link_b + 1])
    total[np.arange(len(x.a)) + before_b[group_a]] = x.a + n * (x.link_a[group_a] == np.arange(len(x.a)))
    total[np.arange(len(x.b)) + x.link_a[group_b] + 1] = (
        2 * n + x.b + len(encoders.b_bytes) * (x.link_b[group_b] == np.arange(len(x.b))))
    out, at = [], 0
    for end in np.cumsum(x.a_counts + x.b_counts).tolist():
        out.append("".join(map(encoders.written.__getitem__, total[at:end].tolist()))[:-1])
        at = end
    return out


def _digest(x: Aligned, encoders: Encoders) -> pa.StructArray:
    n = len(x.a_counts)
    text = x.text_of("a", x.link_a)
    groups = np.bincount(text, minlength=n)
    group_sizes = np.diff(x.groups_b.transpose().indptr)
    shared = np.bincount(x.text_of("a", np.arange(len(x.a))), group_sizes[x.groups_a.indices], minlength=n).astype(np.int64)
    ids_a, ids_b = len(encoders.a_bytes), len(encoders.b_bytes)
    key, counts = np.unique((text * ids_a + x.a[x.link_a]) * ids_b + x.b[x.link_b], return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(key // (ids_a * ids_b), minlength=n))])
    fields = [pa.field(c, pa.int32()) for c in "abn"]
    pairs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (key // ids_b % ids_a, key % ids_b, counts)], fields=fields)
    columns = [pa.array(x.a_counts), pa.array(x.b_counts), pa.array(groups.astype(np.int64)), pa.array(shared),
               pa.array(_written_groups(x, encoders), pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
    return pa.StructArray.from_arrays(columns, list(ALIGNED))


# ------------------------------------------------------------------------ tables

def align(docs: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """``docs`` with the number of tokens of both models, of groups and of token pairs that share a group, ``groups`` written as
    ``a1,a2|b1;a3|b2,b3`` (ids), and ``pairs``: the linked id pairs with their number of links."""
    small_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        encoders = _encoders(vocabularies)
        made = [_digest(x, encoders) for _, x in _aligned(texts, encoders)]
        give_back()
        return pa.concat_arrays(made) if made else pa.array([], _arrow_type())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ALIGNED]
    out = docs.select(*kept, F.arrow_udf(run, _TYPE)(F.col(f"`{text}`")).alias("__aligned"))
    return out.select(*kept, "__aligned.*")


def _arrow_type() -> pa.DataType:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    pairs = pa.list_(pa.struct([(c, pa.int32()) for c in "abn"]))
    return pa.struct([(c, kinds.get(t, pairs)) for c, t in ALIGNED.items()])


LINKS = ("overlap", "end", "group")


def links(docs: DataFrame, vocabularies: Vocabularies, kind: str = "end", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every link: ``key``, the numbers ``a`` and ``b`` of the two tokens in their text, their ids, and ``weight``: for overlaps the
    bytes that they share, else 1. ``kind``: tokens that ``overlap``, that ``end`` together, or that share a ``group``."""
    if kind not in LINKS:
        raise ValueError(f"no links {kind!r}")
    small_batches(docs.sparkSession)

    def found(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if kind == "overlap":
            yield x.overlaps
        elif kind == "end":
            yield x.link_a, x.link_b, np.ones(len(x.link_a), np.int64)
        else:
            for a, b in x.shared():
                yield a, b, np.ones(len(a), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(vocabularies)
        for batch in batches:
            for first, x in _aligned(batch.column(1), encoders):
                start_a, start_b = (np.cumsum(c) - c for c in (x.a_counts, x.b_counts))
                for a, b, weight in found(x):
                    for s in range(0, len(a), 100_000):
                        i, j, w = a[s:s + 100_000], b[s:s + 100_000], weight[s:s + 100_000]
                        doc = x.text_of("a", i)
                        yield pa.record_batch([
                            batch.column(0).take(pa.array(first + doc)), pa.array(i - start_a[doc], pa.int64()),
                            pa.array(j - start_b[doc], pa.int64()), pa.array(x.a[i], pa.int32()), pa.array(x.b[j], pa.int32()),
                            pa.array(w, pa.int64())], [key, "a", "b", "a_id", "b_id", "weight"])
            give_back()

    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        run, f"`{key}` {kind_of_key}, a long, b long, a_id int, b_id int, weight long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``links`` over all rows, and ``best``: whether no other A id has more links with this B id."""
    counts = (aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("links")))
    counts = materialize(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("links").alias("top")).withColumnRenamed("b", "top_b")
    return counts.join(broadcast_below(top), F.col("b") == F.col("top_b")).select("a", "b", "links", (F.col("links") == F.col("top")).alias("best"))


def weigh_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (of :func:`align`, what is needed of it) with ``n_links``, ``n_best`` (links whose id pair is the most frequent of its B id) and
    ``count_sum`` (the sum over the links of their pair's links in the corpus)."""
    kept = [c for c in aligned.columns if c not in ("n_links", "n_best", "count_sum")]
    rows = materialize(aligned.select(*kept).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = broadcast_below(materialize(pair_counts(rows), "pair-weights").withColumnsRenamed({"a": "ca", "b": "cb"}), 4_000_000)
    found = rows.select("__row", F.explode("pairs").alias("p")).join(counts, (F.col("p.a") == F.col("ca")) & (F.col("p.b") == F.col("cb")))

    def total(value: Column) -> Column:
        return F.sum(F.col("p.n") * value)

    weighed = found.groupBy("__row").agg(
        total(F.lit(1)).alias("n_links"), total(F.col("best").cast("int")).alias("n_best"), total(F.col("links")).alias("count_sum"))
    weighed = weighed.withColumnRenamed("__row", "__of")
    joined = rows.join(weighed, F.col("__row") == F.col("__of"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept],
                         *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")])

