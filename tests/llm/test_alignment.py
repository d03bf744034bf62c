import hashlib
import random
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
import sentencepiece
from helpers import ODD, by_id, docs
from tokenizers import Tokenizer

from tallyloom.llm import alignment as A, catalog

SF = "/root/testdata/sf0.001"
FILES = A.load_vocabularies(catalog.BYTE_MODEL, catalog.PIECE_MODEL)


@lru_cache
def libraries():
    a = Tokenizer.from_file(catalog.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=catalog.PIECE_MODEL), A.byte_signs()


def tokens(text):
    """(id, end in bytes) of both sequences, by the two libraries; none if they do not spell the text."""
    a, b, signs = libraries()
    if not text:
        return [], []
    out, bodies = [], []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(signs[c] for c in a.id_to_token(i))),
                       (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                        else b.id_to_piece(i).replace("▁", " ").encode())):
        spelled = [spell(i) for i in ids]
        out.append(list(zip(ids, accumulate(map(len, spelled)))))
        bodies.append(b"".join(spelled))
    return tuple(out) if bodies == [(" " + text).encode()] * 2 else ([], [])


def by_hand(rows):
    """What the query returns, pair by pair."""
    seen = []
    for key, text in rows:
        a, b = tokens(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, ends = [([], []) for _ in cuts], {}
        for side, row in enumerate((a, b)):
            for i, e in row:
                groups[bisect_left(cuts, e)][side].append(i)
        for j, f in b:
            ends.setdefault(f, []).append(j)
        linked = [(i, j) for i, e in a for j in ends.get(e, [])]
        seen.append((key, len(a), len(b), groups, linked))
    counts = Counter(p for *_, linked in seen for p in linked)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for key, n_a, n_b, groups, linked in seen:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, n_a, n_b, len(groups), len(linked), sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked),
                    hashlib.sha256(written.encode()).hexdigest() if written else "", sum(len(x) * len(y) for x, y in groups)))
    return sorted(out, key=repr)


def weighed(df):
    out = A.weigh_links(A.align(df, FILES).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))))
    return sorted([tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha", "n_shared").collect()], key=repr)


TEXTS = ["<|endoftext|> and <s> </s> <unk>", "café 中文 \U0001f600\U0001f600", "under▁score", " two  spaces ", "\t\n \r\n", "'s 'll don't",
         " 　 x", "\x00\x01", "é́", "12345 3.14", "=" * 50, "﻿bom", "İı", "   ", "Å", "ẞß"]


def random_texts(rng, n):
    signs = [*"abcdefg THE ing'sé中\n\t 019.,!?-_", "\U0001f600", "▁", " the", "ing", "́", " "]
    return [rng.choice([None, "", rng.choice(TEXTS), "".join(rng.choice(signs) for _ in range(rng.randrange(60)))]) for _ in range(n)]


def dense(m):
    out = np.zeros((m.n_rows, m.n_cols), int)
    np.add.at(out, (m.rows(), m.indices), 1)
    return out


def test_products_against_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k, m = rng.integers(0, 7, 3)
        made = []
        for rows, cols in ((n, k), (k, m)):
            filled = [np.flatnonzero(rng.random(cols) < 0.4) for _ in range(rows)]
            made.append(A.Csr(np.concatenate([[0], np.cumsum([len(f) for f in filled])]).astype(int),
                              np.concatenate([np.zeros(0, int), *filled]).astype(int), int(cols)))
        a, b = made
        assert (dense(a.transpose()) == dense(a).T).all()
        want = dense(a) @ dense(b)
        rows, cols, values = A.multiply(a, b)
        got = np.zeros_like(want)
        got[rows, cols] = values
        assert (got == want).all() and len(rows) == np.count_nonzero(want)
        if n:
            assert (dense(a.slice(1, int(n))) == dense(a)[1:]).all()


def test_against_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS + random_texts(random.Random(6), 250))]
    rows += rows[:30]
    assert weighed(docs(spark, rows).repartition(3)) == by_hand(rows)
    monkeypatch.setattr(A, "CHUNK_BYTES", 40)  # few texts are put together
    chunks = [c for _, c in A._aligned(pa.array([t for _, t in rows]), A._encoders(FILES))]
    assert len(chunks) > 50 and sum(len(c.a_counts) for c in chunks) == len(rows)


def test_all_links(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS + random_texts(random.Random(7), 60))]
    want = {kind: set() for kind in A.LINKS}
    for key, text in rows:
        a, b = tokens(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        group = lambda e: sum(c < e for c in cuts)
        start_a, start_b = [[0] + [e for _, e in side] for side in (a, b)]
        for p, (i, e) in enumerate(a):
            for q, (j, f) in enumerate(b):
                common = min(e, f) - max(start_a[p], start_b[q])
                if common > 0:
                    want["overlap"].add((key, p, q, i, j, common))
                if e == f:
                    want["end"].add((key, p, q, i, j, 1))
                if group(e) == group(f):
                    want["group"].add((key, p, q, i, j, 1))
    for kind in A.LINKS:
        got = [tuple(r) for r in A.links(docs(spark, rows), FILES, kind).collect()]
        assert len(got) == len(set(got)) and set(got) == want[kind]
    with pytest.raises(ValueError):
        A.links(docs(spark, rows), FILES, "near")


def test_byte_tokens_of_every_sign():
    """The fast encoder cuts words at the same signs as the library, for every code point."""
    encoders, (library, _, _) = A._encoders(FILES), libraries()
    texts = [f" a{c}b 1{c}2 {c} {c}!{c}\n" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for k in range(0, len(texts), 50_000):
        for text, want in zip(texts[k:k + 50_000], library.encode_batch_fast(texts[k:k + 50_000], add_special_tokens=False)):
            assert encoders.encode_a(text) == want.ids, ascii(text)


@pytest.mark.parametrize("text", ["x" * 100_000, " " * 300_000 + "a", "\n \t" * 100_000, "1" * 100_000, "é" * 50_000, "!" * 100_000, " " * 1999 + "b"])
def test_long_runs(text):
    library = libraries()[0]
    assert A._encoders(FILES).encode_a(text) == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 9]
    assert weighed(docs(spark, rows)) == by_hand(rows)
    out = A.align(docs(spark, ODD), FILES)
    assert out.count() == len(ODD) and len(set(out.columns)) == len(out.columns)
    empty = A.weigh_links(A.align(docs(spark, []), FILES))
    assert empty.count() == 0
    assert A.links(docs(spark, []), FILES, "overlap").count() == 0


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = by_id(catalog.op13_tokenizer_alignment(spark, SF))
    want = by_hand(rows)
    assert sorted([tuple(r) for r in got.values()], key=repr) == want
