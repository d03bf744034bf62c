import random
import re

from helpers import by_id, check_odd, docs

from tallyloom.llm import personal


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [(kinds[k][0], s, e) for s, k, e in sorted(found)]


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(1)
    alphabet = "ab@.12 -+9()_%3.5.0é"
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
        assert [(x["kind"], x["start"], x["end"]) for x in personal.find_spans(text) if x["base"]] == base_spans(text), text


def test_checksums_and_context():
    def kinds(text):
        return [x["kind"] for x in personal.find_spans(text)]

    assert kinds("pay to GB82 WEST 1234 5698 7654 32 NOW") == ["iban"]
    assert kinds("pay to GB83 WEST 1234 5698 7654 32 NOW") == []
    assert kinds("card 4111 1111 1111 1111") == ["card"] and kinds("card 4111 1111 1111 1112") == []
    assert kinds("call (212) 555-1234 today") == ["national_phone"] and kinds("part (212) 555-1234") == []
    assert kinds("her ssn is 123-45-6789") == ["national_id"] and kinds("ssn 000-45-6789") == []
    assert kinds("at 300.1.1.1 and 25.1.1.255") == ["ip"]
    plain, near = (personal.find_spans(t)[0]["score"] for t in ("x 10.0.0.1", "server 10.0.0.1"))
    assert near > plain


def test_context_is_whole_words_and_can_lower():
    def scores(text):
        return [(x["kind"], round(x["score"], 2)) for x in personal.find_spans(text)]

    assert scores("I tell you 555-123-4567") == [] and scores("tel 555-123-4567") == [("national_phone", 0.65)]
    assert scores("ipsum 10.0.0.1") == [("ip", 0.6)] and scores("two servers 10.0.0.1") == [("ip", 0.95)]
    assert scores("release 10.0.0.1") == [("ip", 0.25)]  # a base span stays, whatever its score
    assert scores("call us, order 555-123-4567") == []
    assert scores("write an email to a@b.cd") == [("email", 1.0)]
    gap = " " * (personal.CONTEXT_CHARS - 3)
    assert scores(f"hotel{gap}555-123-4567") == [] and scores(f"tel{gap}555-123-4567") == [("national_phone", 0.65)]


def test_odd_rows_and_redaction(spark):
    check_odd(spark, personal.find_personal)
    found = personal.find_personal(docs(spark, [(1, "mail é@x a.b@c.de, or +1 (626) 555-5759."), (2, None)]))
    got = by_id(personal.redact(found))
    assert got[1]["redacted"] == "mail é@x <email>, or <phone>." and got[2]["redacted"] == ""


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "1" * 300_000 + "1." * 100_000 + "+1" * 50_000
    assert isinstance(personal.find_spans(text), list)
