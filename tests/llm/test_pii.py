import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def good(kind, s):
    d = digits(s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text) if good(k, m[0])]


parts = st.sampled_from(list("a.@-+ 15()é%_") + ["ab@c.de", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-1234", "x@y", "@@", "..", "a.b@c-d.e.f"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert [x for x in pii.find(text) if x[0] != "iban"] == brute(text)


def test_validators_and_redaction():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432")
    text = "pay GB82 WEST 1234 5698 7654 32 or mail a.b@c.de, tel +1 (555) 555-1234."
    assert {k for k, _, _ in pii.find(text)} == {"iban", "email", "phone"}
    assert pii.redact(text) == "pay [IBAN] or mail [EMAIL], tel [PHONE]."
    assert pii.find("") == [] and pii.redact("") == ""


def test_context_raises_the_score():
    assert pii.score("call +1 555 555 1234", "phone", 5, 20) > pii.score("zzzz +1 555 555 1234", "phone", 5, 20)


def test_long_runs_take_linear_time():
    n = 200_000
    for text in ("a" * n + "@", "1" * n + ".", "1." * n, "@a" * n, "+" * n, "+1 " * (n // 3)):
        pii.find(text)


def test_every_column_against_the_plain_patterns(spark):
    rnd = random.Random(5)
    parts = ["a.b@c.de", "x@y", "10.0.0.255", "1.2.3.456", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "card", "mail", "é日", "@", "+", ".", "7"]
    rows = [(k, rnd.choice([" ", "", "\n"]).join(rnd.choice(parts) for _ in range(rnd.randrange(9)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "no data"), (903, "a" * 200_000 + "@b.c " + "1" * 2_000 + "." * 2_000), (904, "a.b@c.de"), (904, "a.b@c.de"), (None, "1.2.3.4")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_email int, spans string")
    got = sorted((tuple(r) for r in pii.find_pii(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "n_iban", "spans", "score").collect()), key=str)
    assert len(got) == len(rows)
    want = {}
    for k, text in rows:
        spans = brute(text or "")
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        want[k] = (*(sum(s[0] == kind for s in spans) for kind in BASE), hashlib.sha256(told.encode()).hexdigest(), told)
    for r in got:
        assert r[1:6] == want[r[0]][:5]
        own = [x for x in r[7].split(",") if x and not x.startswith("iban")]
        assert ",".join(own) == want[r[0]][5] and len(r[7].split(",")) - (r[7] == "") == sum(r[1:5]) + r[6]
        assert 0 <= r[8] <= 1 and (r[8] > 0) == (r[7] != "")
    assert sum(r[6] for r in got) > 20
    assert pii.find_pii(df.limit(0)).collect() == []
