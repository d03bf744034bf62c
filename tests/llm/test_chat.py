import hashlib
import random
import time

import pytest
from helpers import by_id
from hypothesis import given, settings, strategies as st

from tallyloom.llm import catalog, chat as C

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, segment string, position string, loss_start string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[ROLE ]", "[/ROLE]", "[ROLE a b]", "\\", "\\\\",
          " ", "\n", "a", "é", "<", ">", "[", "]", "/", "INST", "s", "SYS", "ROLE "]
ROLES = ["user", "assistant", "system", "tool", "", "a]b c\n", "%41", "é", "[ROLE x]", "~"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def formatted_texts(rows):
    """conv -> formatted text, put together from the segments."""
    out = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        out[r["conv"]] = out.get(r["conv"], "") + r["segment"]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), max_size=5))
def test_any_conversation_reads_back(said):
    text = C.START + "".join(C.render_turn(r, t)[0] for r, t in said)
    assert C.parse(text) == said
    for role, body in said:
        rendered, start, end = C.render_turn(role, body)
        assert C.unescape(rendered[start:end]) == body
        assert (rendered[start:end] == body) == (C._CONTROL.search(body) is None)  # only what conflicts is changed


def test_plain_texts_stay_as_they_are():
    assert C.render_turn("user", "a [b] <c> \\ d") == ("[INST] a [b] <c> \\ d [/INST]", 7, 20)
    assert C.render_turn("assistant", "") == ("  </s>", 1, 1)
    assert C.render_turn("system", "be\nbrief")[0] == "<<SYS>>\nbe\nbrief\n<</SYS>>\n\n"
    assert C.render_turn("tool use", "1")[0] == "[ROLE tool%20use] 1 [/ROLE]"
    assert C.render_turn("user", "\\[INST]")[0] == "[INST] \\\\[INST] [/INST]"


@pytest.mark.parametrize("text", ["", "x", "<s>x", "<s>[INST] x", "<s>[INST] x</s>", "<s>[INST] x [/INST]y", "<s>[INST] x [/INST] y</s>",
                                  "<s>[INST] x</s> [/INST]", "<s>[INST][/INST]", "<s>[INST] [/INST]"])
def test_what_the_grammar_does_not_produce(text):
    with pytest.raises(C.GrammarError):
        C.parse(text)


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("\\" * 400_000, "[INST]" * 60_000, "\\[INST]" * 50_000, "[ROLE " + "a" * 300_000, "[" * 300_000, "<" * 300_000):
        rendered = C.render_turn("user", text)[0]
        assert C.parse(C.START + rendered) == [("user", text)]
    assert time.time() - start < 10


def brute(rows):
    """What a plain reading of the source says, conversation by conversation."""
    out = {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    text_first = lambda v: (v is not None, v or "")
    for conv, turn, role, text in sorted(rows, key=lambda r: (none_first(r[0]), none_first(r[1]), text_first(r[2]), text_first(r[3]))):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {k: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"),
                sha("".join(t for r, t in v if r == "assistant"))) for k, v in out.items()}


def random_rows(rng):
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))])
            rows.append((conv, rng.choice([turn, turn, None, 1]), rng.choice([*ROLES, None, "assistant"]), text))
    return rows + rows[:5]


def test_against_brute_force(spark, monkeypatch):
    rows = random_rows(random.Random(4))
    formatted = C.format_conversations(turns(spark, rows).repartition(3))
    assert formatted.columns == ["conv", "position", "segment", "loss_start", "loss_end"]
    kept = formatted.collect()
    texts = formatted_texts(kept)
    want = brute(rows)
    for read in (C.read_conversations(formatted, in_order=True), C.read_conversations(formatted.repartition(4))):
        got = {r["conv"]: r for r in read.collect()}
        assert {k: tuple(r)[1:5] for k, r in got.items()} == want
        assert {k: r["formatted_chars"] for k, r in got.items()} == {k: len(t) for k, t in texts.items()}
    for conv, text in texts.items():
        said = C.parse(text)
        assert sha("".join(f"{r}\n{t}\n" for r, t in said)) == want[conv][1]
        spans = [(r["loss_start"], r["loss_end"]) for r in sorted(kept, key=lambda r: r["position"]) if r["conv"] == conv and r["loss_start"] is not None]
        assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in said if r == "assistant"]


def test_segments_cut_anywhere():
    rng = random.Random(8)
    said = [("user", "hi </s>"), ("assistant", "[INST] é\\"), ("tool", ""), ("assistant", "bye")]
    text, spans = C.START, []
    for role, body in said:
        rendered, a, b = C.render_turn(role, body)
        spans += [(len(text) + a, len(text) + b)] if role == "assistant" else []
        text += rendered
    for _ in range(200):
        reader, at, left = C._Reader(), 0, list(spans)
        while at < len(text):
            step = rng.randrange(1, 9)
            here = left.pop(0) if left and left[0][0] < at + step else None
            reader.feed(text[at:at + step], here)
            at += step
        n, digest, chars, learned, length = reader.result()
        assert (n, length, learned) == (4, len(text), sha("[INST] é\\bye"))


def test_no_rows_and_long_conversations(spark):
    assert C.read_conversations(C.format_conversations(turns(spark, []))).count() == 0
    rows = [(1, k, ("user", "assistant")[k % 2], "word " * 50 + "</s>") for k in range(4000)] + [(2, 0, "user", "x" * 500_000)]
    got = {r["conv"]: tuple(r)[1:5] for r in C.read_conversations(C.format_conversations(turns(spark, rows)), in_order=True).collect()}
    assert got == brute(rows)


def test_query_against_brute_force(spark):
    source = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = by_id(catalog.op12_chat_round_trip(spark, SF), "conv_id")
    assert {k: tuple(r)[1:5] for k, r in got.items()} == brute(source + catalog.CONFLICT)
    body = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_chars"] == len(body) and got[-1]["formatted_chars"] == len(C.START + "".join(C.render_turn(r, body)[0] for r in ("user", "assistant")))
