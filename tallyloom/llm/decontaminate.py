"""Benchmark items inside documents, up to a share of edited characters.

Both sides are reduced to lower-case words joined by one space. An item of n characters may differ by
k = n * ``error_rate`` edits, so it is cut into k + 1 pieces, of which one must stand unchanged in a document that
holds the item. All pieces are sought in one scan of the document; around every hit the item is verified by
Myers' bit-parallel distance, with a free start and end. An item too short for an edit must stand as whole words.

The benchmark is the stated query set. It goes to the tasks in blocks of at most about ``BLOCK_CHARS`` characters. A pass over the
documents holds up to ``PASS_BLOCKS`` of them, whose indexes a worker builds once; a larger benchmark takes as many passes as it
needs, with the documents and what was found so far written between them. Documents are never shuffled.

Edge cases: ids of items may be of any type that has an order; a null or empty text holds no item; a null, empty or wordless item is
in no document; items that repeat under one id count once; equal documents get equal rows; an empty table on either side gives no leak; an input
column named ``leaks`` is replaced.
"""
from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm.arrow import small_batches
from tallyloom.plans.small import materialize

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
PASS_BLOCKS = 4
_WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, error_rate: float = ERROR_RATE) -> list[tuple[str, int]]:
    """The k + 1 pieces of an item and where they start; sizes differ by one at most."""
    count = int(len(item) * error_rate) + 1
    cuts = [len(item) * j // count for j in range(count + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, masks: dict[str, int], text: str) -> int:
    """Least edit distance of ``pattern`` to any part of ``text``. ``masks``: the positions of every character
    of the pattern as bits."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for ch in text:
        eq = masks.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        grows, falls = down | (~(xh | up) & full), up & xh
        if grows & top:
            score += 1
        elif falls & top:
            score -= 1
            if score < best:
                best = score
        grows, falls = (grows << 1) & full, (falls << 1) & full  # a free start: nothing enters below
        up, down = falls | (~(xv | grows) & full), grows & xv
    return best


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(pattern):
        masks[ch] |= 1 << k
    return dict(masks)


class ItemIndex:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], error_rate: float):
        self.items = {n: (i, n, int(len(n) * error_rate), bit_masks(n))
                      for i, n in sorted(((i, normal(t)) for i, t in items), reverse=True) if n}
        self.by_text: dict[str, list] = defaultdict(list)
        for i, t in set((i, normal(t)) for i, t in items):
            self.by_text[t].append(i)
        owners: dict[str, list] = defaultdict(list)
        for entry in self.items.values():
            for piece, at in pieces(entry[1], error_rate):
                owners[piece].append((entry, at))
        self.automaton = ahocorasick.Automaton() if owners else None
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        """The items in a text with their least distance."""
        body, best, tried = normal(text), {}, set()
        for end, (size, own) in self.automaton.iter(body) if self.automaton and body else ():
            for (_, item, budget, masks), at in own:
                start = end + 1 - size - at  # where the item would start without edits
                if not budget and f" {body[max(0, start - 1):end + 2].strip()} " != f" {item} ":
                    continue
                if best.get(item) == 0 or (item, start) in tried:
                    continue
                tried.add((item, start))
                window = body[max(0, start - budget):start + len(item) + budget]
                distance = 0 if item in window else myers(item, masks, window) if budget else 1
                if distance <= budget and distance < best.get(item, budget + 1):
                    best[item] = distance
        found: dict = {}
        for item, distance in best.items():
            for i in self.by_text[item]:
                found[i] = min(distance, found.get(i, distance))
        return [{"item_id": i, "distance": d} for i, d in sorted(found.items())]


class _Block:
    """A broadcast block of items under a name of its own, by which a worker finds the index it has built."""

    def __init__(self, items):
        self.items, self.name = items, uuid.uuid4().hex

    def __eq__(self, other) -> bool:
        return self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)


@lru_cache(maxsize=PASS_BLOCKS)
def _index(block: _Block, error_rate: float) -> ItemIndex:
    return ItemIndex(list(block.items.value), error_rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
               item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items it holds and their edit distances."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    kind = items.schema["i"].dataType
    leaks_type = f"array<struct<item_id:{kind.simpleString()},distance:int>>"
    leak = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("distance", pa.int32())]))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))

    def search(number: int):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number)
        block = _Block(spark.sparkContext.broadcast(tuple(sorted((r["i"], r["t"]) for r in own.toLocalIterator()))))
        held.append(block.items)

        def find(texts: pa.Array) -> pa.Array:
            index = _index(block, error_rate)
            return pa.array([index.find(t.as_py()) for t in texts], leak)

        return F.arrow_udf(find, leaks_type)(F.col(text))

    found, held = docs, []
    for start in range(0, blocks, PASS_BLOCKS):
        before = [F.col("leaks")] if start else []
        now = F.concat(*before, *[search(b) for b in range(start, min(start + PASS_BLOCKS, blocks))])
        found = found.withColumn("leaks", now)
        if start + PASS_BLOCKS < blocks:
            found = materialize(found, "leaks")
            while held:
                held.pop().unpersist()
    return found
