"""PII against a plain Python reading of the contract."""

import hashlib
import re

from cairn.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        t += d - 9 if d > 9 else d
    return t % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute(text):
    found = [(m.start(), no, m.end(), k) for no, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found)


TEXTS = [
    None,
    "",
    "write a.b%c@d-e.f.co.uk. or x@y, x@@y.z a@b.c_d@e.f..g",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 00000255.0.0.1 1.2.3 1.2.3.4.",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111 and 49927398716 7992739871300000",
    "call +49 (30) 1234-5678 now +1 2 +12345678901234567 +1-800-555-01999. +",
    "é 𝒳 ü +33 1 23 45 67 89 a@b.cd 𝒳 10.0.0.1",
    "1 " * 5000 + "a.b." * 5000 + "x@" + "y." * 5000 + "z",
    "9" * 40000,
    "\x01 1\x012 a@b\x01c.d 4111\x011111",
    "IBAN GB82 WEST 1234 5698 7654 32 not GB82 WEST 1234 5698 7654 33",
    "ssn 123-45-6789 and 123-45-6789",
]


def test_base_spans_are_those_of_the_contract(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as _text", "2 as _spans", "'x' as kind")
    got = pii.digest(df).collect()
    assert len(got) == len(rows)
    text = dict(rows) | {None: "a@b.cd"}
    for r in got:
        want = brute(text[r.doc_id])
        spans = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), (r.doc_id, spans, r.spans)
        for k in BASE:
            assert r[f"n_{k}"] == sum(x[3] == k for x in want)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_validators_and_context_decide_on_added_kinds(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS[-2:])]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].count("iban:") == 1 and "iban:5:32" in got[0]
    assert got[1].count("ssn:") == 2  # context reaches both


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "a x@y.zz b 10.0.0.1"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "a [EMAIL] b [IP]", 2: None, 3: "clean"}
    assert pii.digest(df.limit(0)).count() == 0
