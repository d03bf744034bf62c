import random
import re
from collections import Counter

from helpers import by_id, check_odd, docs, plan

from tallyloom.llm import quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def columns(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "ü ", "#", "| ", "\x0b", "\u00a0", "\r", "\x1f"]) for _ in range(rng.randrange(90)))
             for _ in range(400)]
    texts += ["one two three four five", "one two three four five " * 2, "a b c d e f a b c d e g", None, "", "\n\n"]
    got = by_id(quality.judge_quality(docs(spark, list(enumerate(texts)))))
    for k, t in enumerate(texts):
        assert columns(got[k]) == base(t), repr(t)


def test_lines(spark):
    prose = "It was a long day and nobody in the house had slept well before it began."
    rows = {1: prose, 2: f"{prose}\nWe use cookies to make this site work.\n{prose} Indeed.",
            3: "Home | About | News | Sports | Contact | Login | More\n" + prose,
            4: "*** $$$ ### %%%\n" + prose, 5: "Click here\n" * 2 + "Read more about it\nShare on Facebook " * 6,
            6: prose + "\n\n" + prose + " Twice."}
    got = by_id(quality.judge_quality(docs(spark, list(rows.items()))))
    assert got[1]["clean_text"] == prose and got[1]["kept"] and got[1]["lost"] == 0
    assert got[2]["clean_text"] == f"{prose}\n{prose} Indeed." and 0 < got[2]["lost"] < 0.5 and got[2]["base_failed"]
    assert got[3]["clean_text"] == prose and got[4]["clean_text"] == prose
    assert not got[5]["kept"] and got[6]["clean_text"] == rows[6]


def test_odd_rows(spark):
    got = check_odd(spark, lambda d: quality.judge_quality(d).drop("clean_text"))
    assert {r["doc_id"]: r["n_words"] for r in got.collect() if r["doc_id"]}[7] == 20_000
    assert not any(r["kept"] for r in got.collect() if r["n_words"] < 10)


def test_no_python_in_the_plan(spark):
    assert "Python" not in plan(quality.judge_quality(docs(spark, [(1, "x")])))
