"""SentencePiece encoding and decoding: a relational lattice over distinct words, folded by higher-order functions.

Texts are cut where no piece can reach across: before runs of the space mark, at line breaks, and between a letter and
a punctuation mark that follows a letter in no piece. Every task names its distinct words; the distinct words of the
corpus are exploded to all substrings of at most the longest piece's length, joined by equality to the piece table and
grouped by word again, and a higher-order ``aggregate`` folds the edges of a word. A character without a piece has an edge
of its own and is encoded as bytes. The words' ids return to the blocks of documents that asked for them, and each
block is put together.

A unigram model is folded by Viterbi: over the edges by end and start the fold keeps the best score of each end and its
edge, and a second fold walks back; of equal sums the path whose last piece starts first wins. The scores of a merge
model (BPE) are ranks, whose sums mean nothing, so Viterbi would not give the model's ids. There the edges come by rank and
place, and the fold's state is the set of the word's current boundaries, as bits: an edge with boundaries at both ends and
one inside removes that one. Where a merge makes a piece that a better ranked piece could take up, the fold of that
word is repeated edge by edge from the best rank after every merge, which is the definition of merging.

What is broadcast is the piece table, whose size the model file fixes. Words of more than ``LONG`` characters are folded
where they stand, by the same rules.

Edge cases: a null text counts as empty, and an empty text has no ids; the space mark itself decodes to a space, every other
text comes back exactly; repeated rows come out alike; null ids are kept; an empty table gives an empty result;
other columns are not looked at.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.arrow import give_back, small_batches
from tallyloom.plans.small import literal_table

SPACE = "▁"
LONG = 60                     # boundaries of a word and a flag fit a bigint
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # kinds of pieces in a model file
UNIGRAM_MODEL, MERGE_MODEL = 1, 2
MAX_PIECES = 1_000_000
BLOCK_BYTES = 32 << 20        # text of the documents that are put together in one step
SPLIT_BYTES = 1 << 28         # larger batches are split text by text
ANSWERS_HELD = 300_000
WORDS_AT_ONCE = 20_000        # words that are objects of Python at a time
ROWS_AT_ONCE = 256            # documents that a task puts together at a time
IDS_AT_ONCE = 1 << 18         # ids that a task decodes at a time


@dataclass(frozen=True)
class PieceModel:
    """The pieces of a model file and what its normalizer does."""
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind; the position is the id
    add_dummy_prefix: bool = True
    merges: bool = False  # a merge model (BPE), not a unigram model

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {t: (i, s) for i, (t, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def reach(self) -> dict[str, int]:
        """The longest piece's length for the first three characters of pieces."""
        found: dict[str, int] = {}
        for t in self.table:
            if len(t) > 2:
                found[t[:3]] = max(found.get(t[:3], 0), len(t))
        return found

    @cached_property
    def unknown_score(self) -> float:
        return min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def byte_ids(self) -> tuple[int, ...] | None:
        ids = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(self.pieces) if kind == BYTE}
        return tuple(ids[b] for b in range(256)) if len(ids) == 256 else None

    @cached_property
    def unknown_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @cached_property
    def newline_alone(self) -> bool:
        """Whether no piece joins a line break to something else."""
        return not any("\n" in p and len(p) > 1 for p in self.table)

    @cached_property
    def word(self) -> re.Pattern:
        """A run of space marks with what follows up to the next one, or up to a line break."""
        if any(SPACE in p.lstrip(SPACE) for p in self.table):
            raise ValueError("pieces that reach across words are not supported")
        alone = "\n" if self.newline_alone else ""
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else ""))

    @cached_property
    def inner_cut(self) -> re.Pattern | None:
        """Between a letter and a mark that follows a letter in no piece."""
        joined = {p[k + 1] for p in self.table for k in range(len(p) - 1) if p[k].isalpha()}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        return re.compile(f"(?<=[^\\W\\d_])(?=[{marks}])") if marks else None

    def words(self, text: str) -> list[str]:
        """The words of a text, which joined are the text with space marks."""
        if not text:
            return []
        return self.word.findall((SPACE if self.add_dummy_prefix else "") + text.replace(" ", SPACE))

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, one after the other, and how many each text has. Where no space follows another one or a mark
        stands in the text, the words are what literal replacements and a split leave; other texts go through ``words``."""
        self.word  # an error for models whose pieces reach across words
        texts = texts.fill_null("")
        plain = pc.invert(pc.or_(pc.match_substring(texts, SPACE), pc.match_substring(texts, "  ")))
        if self.add_dummy_prefix:
            plain = pc.and_(plain, pc.invert(pc.starts_with(texts, " ")))
        if texts.nbytes > SPLIT_BYTES:
            plain = pa.repeat(False, len(texts))
        spaced = pc.replace_substring(pc.if_else(plain, texts, ""), " ", f" {SPACE}")
        if self.newline_alone:
            spaced = pc.replace_substring(spaced, "\n", " \n ")
        if self.add_dummy_prefix:
            spaced = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(SPACE, spaced, ""))
        found = pc.split_pattern(spaced, " ")
        flat, offsets = found.flatten(), found.offsets.to_numpy()
        there = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
        flat = flat.filter(there)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        counts = np.diff(ends)
        if not len(odd):
            return flat, counts
        pieces, at = [], 0
        for k in odd.tolist():
            own = self.words(texts[k].as_py())
            pieces += [flat.slice(at, ends[k] - at), pa.array(own, pa.string())]
            at, counts[k] = ends[k], len(own)
        return pa.concat_arrays([*pieces, flat.slice(at)]), counts

    def parts(self, word: str) -> list[str]:
        return [word] if self.inner_cut is None or word[1:].isalpha() else self.inner_cut.split(word)

    def unknown(self, char: str) -> list[int]:
        return [self.unknown_id] if self.byte_ids is None else [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    @cached_property
    def taken_up(self) -> frozenset[str]:
        """Pieces that are a half of a piece of better or equal rank."""
        halves = ((h, s) for t, (_, s) in self.table.items() for k in range(1, len(t)) for h in (t[:k], t[k:])
                  if t[:k] in self.table and t[k:] in self.table)
        return frozenset(h for h, s in halves if s >= self.table[h][1])

    def fold(self, word: str) -> list[int]:
        """The ids of one word, for words that are too long to be worth a row per substring."""
        cuts = self._merged(word) if self.merges else self._viterbi(word)
        ids = [self.table.get(word[a:b]) for a, b in zip(cuts, cuts[1:])]
        return [i for (a, b), known in zip(zip(cuts, cuts[1:]), ids) for i in ([known[0]] if known else self.unknown(word[a:b]))]

    def _merged(self, word: str) -> list[int]:
        """Boundaries after merging the best ranked neighbours, leftmost first, as long as there are any."""
        after = list(range(1, len(word) + 1)) + [-1]
        before = [-1] + list(range(len(word)))
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and (m := after[a]) != -1 and (b := after[m]) != -1 and (piece := self.table.get(word[a:b])):
                heapq.heappush(queue, (-piece[1], a, m, b))

        for a in range(len(word)):
            offer(a)
        gone = bytearray(len(word) + 1)
        while queue:
            _, a, m, b = heapq.heappop(queue)
            if not gone[a] and after[a] == m and after[m] == b:
                gone[m], after[a], before[b] = 1, b, a
                offer(before[a])
                offer(a)
        return [k for k in range(len(word) + 1) if not gone[k]]

    def _viterbi(self, word: str) -> list[int]:
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(word) + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                piece = self.table.get(word[start:end]) or ((-1, self.unknown_score) if end - start == 1 else None)
                if piece and (found is None or best[start][0] + piece[1] > found[0]):
                    found = (best[start][0] + piece[1], start, piece[0])
            best.append(found)
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        return cuts[::-1]

    def bytes_of(self, i: int) -> bytes:
        """What an id stands for, with spaces for space marks."""
        text, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return {NORMAL: text.replace(SPACE, " "), USER: text.replace(SPACE, " "), UNKNOWN: " ⁇ "}.get(kind, "").encode()


def load_model(path: str) -> PieceModel:
    """Read a SentencePiece model file whose normalizer keeps the text as it is."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only the identity normalizer is supported")
    if model.trainer_spec.model_type not in (UNIGRAM_MODEL, MERGE_MODEL):
        raise ValueError("only unigram and merge models are supported")
    if len(model.pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return PieceModel(tuple((p.piece, p.score, p.type) for p in model.pieces), rules.add_dummy_prefix,
                      model.trainer_spec.model_type == MERGE_MODEL)


def _word_keys(df: DataFrame) -> list[str]:
    return [c for c in ("n_word", "word") if c in df.columns]


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """``word``, ``first``, ``last``, ``id``, ``score``: the edges of every word; id -1 for a character without a piece.
    ``taken_up`` is 1 for a half of a better ranked piece."""
    up = model.taken_up if model.merges else frozenset()
    table = F.broadcast(literal_table(words.sparkSession, [(t, i, float(s), int(t in up)) for t, (i, s) in model.table.items()],
                                      "piece string, id integer, score double, taken_up integer"))
    own = _word_keys(words)
    starts = words.select(*own, F.posexplode(F.sequence(F.lit(1), F.length("word"))).alias("first", "at"))
    tails = starts.select(*own, "first", F.substring(F.col("word"), F.col("at"), F.lit(model.longest)).alias("tail"))
    reach = F.broadcast(literal_table(words.sparkSession, list(model.reach.items()), "begins string, reach integer"))
    tails = tails.join(reach, F.substring(F.col("tail"), F.lit(1), F.lit(3)) == F.col("begins"), "left")
    lengths = F.sequence(F.lit(1), F.least(F.length("tail"), F.coalesce("reach", F.lit(2))))
    parts = tails.select(*own, "first", "tail", F.explode(lengths).alias("n"))
    parts = parts.select(*own, "first", "n", F.substring(F.col("tail"), F.lit(1), F.col("n")).alias("piece"))
    return (parts.join(table, "piece", "left").where("id is not null or n = 1")
            .select(*own, "first", (F.col("first") + F.col("n")).alias("last"), F.coalesce("id", F.lit(-1)).alias("id"),
                    F.coalesce("score", F.lit(model.unknown_score)).alias("score"),
                    F.coalesce("taken_up", F.lit(0)).alias("taken_up")))


def best_paths(edges: DataFrame) -> DataFrame:
    """``word`` and ``path``: the ids of the best path, with the first place of each edge. The fold keeps a state per end of an
    edge reached so far; edges come by end, so the last state is the one to improve or the next to add."""
    edge = F.struct("last", "first", "id", "score")
    state = "array<struct<score:double,first:int,id:int>>"

    def step(s: Column, e: Column) -> Column:
        reached = F.struct((F.get(s, e["first"])["score"] + e["score"]).alias("score"), e["first"].alias("first"), e["id"].alias("id"))
        new = F.size(s) == e["last"]
        better = reached["score"] > F.element_at(s, -1)["score"]
        return (F.when(new, F.concat(s, F.array(reached)))
                .when(better, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(reached))).otherwise(s))

    folded = F.aggregate(F.sort_array(F.collect_list(edge)),
                         F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("first"), F.lit(-1).alias("id"))).cast(state), step)
    best = edges.groupBy(*_word_keys(edges)).agg(folded.alias("s"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("s") - 1),
        F.struct((F.size("s") - 1).alias("at"), F.expr("cast(array() as array<struct<first:int,id:int>>)").alias("path")),
        lambda a, _: F.when(a["at"] == 0, a).otherwise(F.struct(
            F.get(F.col("s"), a["at"])["first"].alias("at"),
            F.concat(F.array(F.struct(F.get(F.col("s"), a["at"])["first"].alias("first"), F.get(F.col("s"), a["at"])["id"].alias("id"))),
                     a["path"]).alias("path"))),
        lambda a: a["path"])
    return best.select("word", walk.alias("path"))


def merged_paths(edges: DataFrame) -> DataFrame:
    """``word`` and ``path`` of a merge model. Boundary k of a word is bit k of the state; bit 63 marks a word in which
    a piece came up that a better ranked one could take up."""
    bit = "shiftleft(1L, {})".format
    with_bits = edges.select(
        *_word_keys(edges), F.struct((-F.col("score")).alias("order"), "first", "id", "taken_up",
                         F.expr(f"{bit('first')} | {bit('last')}").alias("ends"),
                         F.expr(f"{bit('last')} - {bit('first + 1')}").alias("inner")).alias("e"))
    words = with_bits.groupBy(*_word_keys(edges)).agg(F.sort_array(F.collect_list("e")).alias("edges"))
    start = F.expr("shiftleft(1L, length(word) + 1) - 1")

    def applies(m: Column, e: Column) -> Column:
        return (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["inner"])) == 1)

    def without(m: Column, e: Column) -> Column:
        return m.bitwiseAND(F.bitwise_not(e["inner"]))

    once = F.aggregate("edges", start, lambda m, e: F.when(applies(m, e), F.when(
        e["taken_up"] == 1, without(m, e).bitwiseOR(F.lit(-1 << 63))).otherwise(without(m, e))).otherwise(m))

    def best(m: Column) -> Column:
        return F.get(F.filter("edges", lambda e: applies(m, e)), F.lit(0))

    again = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, lambda m, _: F.coalesce(without(m, best(m)), m))
    cut = words.select("word", "edges", once.alias("m")).withColumn("m", F.when(F.col("m") < 0, again).otherwise(F.col("m")))
    kept = F.filter("edges", lambda e: (F.col("m").bitwiseAND(e["ends"]) == e["ends"]) &
                    (F.col("m").bitwiseAND(e["inner"]) == 0))
    return cut.select("word", F.sort_array(F.transform(kept, lambda e: F.struct(e["first"], e["id"]))).alias("path"))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """``word`` and ``path`` of distinct words of at most LONG characters."""
    # words are numbered as they come, so their edges, which no step moves, are in order already when they are grouped
    edges = lattice(words.where("word <> ''").withColumn("n_word", F.monotonically_increasing_id()), model)
    return merged_paths(edges) if model.merges else best_paths(edges)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task with their block. A block ends before the text that would take it over BLOCK_BYTES; so blocks
    depend on the rows of the partition and not on how they are batched."""
    block, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        start = 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if size and size + n > BLOCK_BYTES:
                if k > start:
                    yield block, batch.slice(start, k - start)
                block, size, start = block + 1, 0, k
            size += n
        if batch.num_rows > start:
            yield block, batch.slice(start)


def _requests(model: PieceModel):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []

        def distinct(arrays: list[pa.Array]) -> pa.Array:
            return pa.concat_arrays([pa.array([], pa.string()), *arrays]).unique()

        def out() -> Iterator[pa.RecordBatch]:
            words = distinct(seen)
            seen.clear()
            parts = distinct([pa.array([p for w in words.slice(s, WORDS_AT_ONCE).to_pylist() for p in model.parts(w) if len(p) <= LONG],
                                       pa.string()) for s in range(0, len(words), WORDS_AT_ONCE)])
            for s in range(0, len(parts), WORDS_AT_ONCE):
                part = parts.slice(s, WORDS_AT_ONCE)
                yield pa.record_batch([pa.array(np.full(len(part), now, np.int64)), part], ["block", "word"])

        for block, rows in _blocks(batches, 0):
            if block != now:
                yield from out()
                now = block
                give_back()
            seen.append(model.split(rows.column(0))[0].unique())
            pa.default_memory_pool().release_unused()
        yield from out()
        give_back()
    return ask


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one block as one compressed value."""
    for block, rows in _blocks(batches, 1):
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_packed(rows)], pa.binary())], ["block", "payload"])
    give_back()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers sorted out by block, each block's as one compressed value."""
    held, rows = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        blocks = table.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        for own in np.split(order, cuts):
            part = table.select([1, 2]).take(pa.array(own)).combine_chunks()
            yield pa.record_batch([pa.array([blocks[own[0]]], pa.int64()), pa.array([_packed(part)], pa.binary())],
                                  ["block", "payload"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows > ANSWERS_HELD:
            yield from out()
            held, rows = [], 0
    if held:
        yield from out()
    held = []
    give_back()


def _gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a list column, one after the other, and their sizes."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(offsets[rows], sizes)
    return flat[at], sizes


def _concat(lists: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of list columns as one."""
    flat = [np.asarray(x.flatten(), np.int32) for x in lists]
    sizes = [np.diff(np.asarray(x.offsets)) for x in lists]
    return (np.concatenate([np.zeros(0, np.int32), *flat]),
            np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64))


def _assemble(model: PieceModel):
    """Encode the documents of a block: the distinct words of each batch are looked up in the block's answers."""
    def put_together(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known = [_unpacked(p).combine_chunks() for p in answers.column("payload")]
        give_back()  # what the block before has left
        words = pa.chunked_array([c for t in known for c in t.column("word").chunks], pa.string()).combine_chunks()
        flat, offsets = _concat([c for t in known for c in t.column("ids").chunks])
        del known
        tables = []
        for batch in (b for p in blocks.column("payload") for b in _unpacked(p).to_batches()):
            texts, counts = model.split(batch.column(1))
            coded = texts.dictionary_encode()
            parts = [model.parts(w) for w in coded.dictionary.to_pylist()]
            part_words = pa.array([p for ps in parts for p in ps], pa.string())
            where = pc.index_in(part_words, value_set=words)
            part_rows = where.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own_flat, own_offsets = flat, offsets
            if where.null_count:  # long words, and those of a partition that was cut differently
                missing = np.flatnonzero(where.is_null().to_numpy(zero_copy_only=False))
                folded = [model.fold(part_words[int(k)].as_py()) for k in missing]
                own_flat = np.concatenate([flat, *[np.array(f, np.int32) for f in folded]])
                own_offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(f) for f in folded])]).astype(np.int64)
                part_rows[missing] = len(offsets) - 1 + np.arange(len(missing))
            word_ids, part_sizes = _gather(own_flat, own_offsets, part_rows)
            part_ends = np.concatenate([[0], np.cumsum(part_sizes)])
            word_offsets = part_ends[np.concatenate([[0], np.cumsum([len(ps) for ps in parts])]).astype(np.int64)]
            numbers, ends = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            for s in range(0, len(counts), ROWS_AT_ONCE):
                cuts = ends[s:s + ROWS_AT_ONCE + 1]
                ids, sizes = _gather(word_ids, word_offsets, numbers[cuts[0]:cuts[-1]].astype(np.int64))
                word_ends = np.concatenate([[0], np.cumsum(sizes)])
                column = pa.ListArray.from_arrays(pa.array(word_ends[cuts - cuts[0]].astype(np.int32)), pa.array(ids))
                tables.append(pa.table([pa.chunked_array([batch.column(0).slice(s, ROWS_AT_ONCE)]), pa.chunked_array([column])],
                                       ["doc", "ids"]))
            del batch, texts, coded, parts, part_words, where, part_rows, own_flat, own_offsets, word_ids, word_offsets, numbers
            give_back()
        return pa.concat_tables(tables)
    return put_together


def encode(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` and ``ids`` of every row of ``docs``. A block is some 8 MB of a partition of ``docs``: it asks for
    each of its distinct words once, and its documents travel compressed to the answers. Should a partition differ between
    the two readings, the words a block did not ask for are folded in place."""
    spark = docs.sparkSession
    small_batches(spark)
    # the edges come in the order of their words: sorting them once costs less than a hash table that gives up and sorts twice
    spark.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    # one exchange by word serves the distinct words, their lattice and the join of the answers
    asked = texts.select("text").mapInArrow(_requests(model), "block bigint, word string").repartition(parts, "word")
    words = asked.groupBy("word").agg(F.min("block").alias("one")).where("one >= 0")
    paths = encode_words(words, model)
    plain = F.transform("path", lambda e: e["id"])
    with_bytes = F.flatten(F.transform("path", lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(
        unknown_bytes(F.substring(F.col("word"), e["first"] + 1, F.lit(1)), model))))
    known = paths.select("word", F.when(F.exists("path", lambda e: e["id"] < 0), with_bytes).otherwise(plain).alias("ids"))
    answers = (asked.join(known.hint("shuffle_hash"), "word").select("block", "word", "ids")
               .mapInArrow(_answers, "block bigint, payload binary"))
    blocks = texts.mapInArrow(_payload, "block bigint, payload binary")
    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_assemble(model), f"doc {kind}, ids array<int>"))


def unknown_bytes(char: Column, model: PieceModel) -> Column:
    """The byte pieces of a character, or the unknown piece."""
    if model.byte_ids is None:
        return F.array(F.lit(model.unknown_id))
    table = F.array(*[F.lit(i) for i in model.byte_ids])
    hexed = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)),
                       lambda k: F.get(table, F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("int")))


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the texts of the ids; null ids give a null text, an id that the model does not have
    nothing. Characters that are spread over byte pieces come together; what is no UTF-8 is replaced."""
    small_batches(encoded.sparkSession)
    stands_for = [model.bytes_of(i) for i in range(len(model.pieces))] + [b""]  # the last one for ids that the model does not have
    stock = np.frombuffer(b"".join(stands_for), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in stands_for])]).astype(np.int64)
    skip = 1 if model.add_dummy_prefix else 0

    def texts(values: pa.Array) -> pa.Array:
        out = []
        for some in (values.slice(s, ROWS_AT_ONCE) for s in range(0, len(values), ROWS_AT_ONCE)):
            flat = np.asarray(some.flatten().fill_null(-1))
            flat = np.where((flat >= 0) & (flat < len(stands_for) - 1), flat, len(stands_for) - 1)
            joined = b"".join(_gather(stock, starts, flat[k:k + IDS_AT_ONCE])[0].tobytes() for k in range(0, len(flat), IDS_AT_ONCE))
            ends = np.concatenate([[0], np.cumsum(np.diff(starts)[flat])])
            cuts = ends[np.concatenate([[0], np.cumsum(some.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)].tolist()
            for valid, start, end in zip(some.is_valid().to_pylist(), cuts, cuts[1:]):
                start += skip * (start < end and joined[start:start + 1] == b" ")
                out.append(joined[start:end].decode("utf-8", "replace") if valid else None)
        made = pa.array(out, pa.string())
        del out
        give_back()
        return made

    return encoded.withColumn("decoded", F.arrow_udf(texts, "string")(F.col(ids)))
