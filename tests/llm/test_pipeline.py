"""The pipeline against brute force, stage by stage, and the registered queries."""
import hashlib
import re
import time

import pytest
import test_decontaminate
import test_jaccard
import test_lines
import test_pieces
import test_quality
from oracle import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import catalog, decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "piece_encoding":
            library = test_pieces.library()
            assert {r["doc_id"]: r["ids"] for r in after.collect()} == {k: library.encode(t) for k, t in before.items()}
            break
        assert after.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "quality_rules":
            assert set(got) <= {k for k, t in before.items() if not test_quality.base(t)[-1]}
            clean = {k for k in set(before) - set(got) if not test_quality.base(before[k])[-1]}
            assert all(len(re.findall(r"[#*$%&|]", before[k])) > 0.1 * len(before[k].split()) for k in clean)
        elif name == "line_dedup":
            gone = test_lines.stage_removed(list(before.items()))
            want = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in before.items()}
            assert got == {k: t for k, t in want.items() if t.strip() or not gone[k]}
        elif name == "ngram_jaccard":
            assert got == {i: before[i] for i, c, _ in test_jaccard.classes(list(before.items())) if i == c}
        else:
            def leaks(text):
                body = decontaminate.normal(text)
                return any(n in body or test_decontaminate.edit_inside(n, body) <= int(len(n) * decontaminate.ERROR_RATE)
                           for _, n in bench if n in body or len(body) < 400)

            assert set(got) <= {k for k, t in before.items() if not leaks(t)}
            assert len(before) - len(got) <= 0.1 * len(before) + 3
        docs = after


def test_run_is_the_chain_of_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces"] and 0 < out.count() <= 200


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_over_no_rows(spark, name):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, SF).count() == 0


def test_queries(spark):
    every = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in every} and "pipeline" in every
    for name in ("op2_redirect_blocks", "op11_merkle_manifest", "op12_chat_round_trip"):
        assert compare(spark, connect(SF), name, SF)[0] == ""


def test_decoded_digests(spark):
    out = catalog.op10_piece_lattice(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert all(r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out.collect())


def test_line_dedup_leaves_no_shuffle_files(spark):
    """What the steps of the second stage have shuffled is off the disk before the documents are."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [files.apply(k) for k in range(files.size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = shuffled()
    corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    until = time.time() + 20
    while (left := sum(size for name, size in shuffled().items() if name not in before)) > 10_000 and time.time() < until:
        time.sleep(0.5)  # they go in the background
    assert left <= 10_000  # a count of rows
