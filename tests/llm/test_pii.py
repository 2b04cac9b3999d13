import random
import re

import duckdb

from eddyline.llm import pii
from tests.llm import helpers as H


def _check(rows, texts):
    for d, t in texts:
        want = H.base_spans(t)
        r = rows[d]
        assert r["base_sha256"] == H.sha(",".join(want))
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(f"{k}:") for s in want) for k in pii.BASE]
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


def test_documents(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{H.SMALL}/documents.parquet'").fetchall()
    _check({r["doc_id"]: r for r in pii.op2_pii(spark, H.SMALL).collect()}, texts)


def test_random_texts(spark, tmp_path):
    r = random.Random(4)
    parts = ["a@b.c", "x.y@z-w.co.uk", "@", ".", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "+49 30 1234567",
             "1", "12", " ", "-", "_", "😀", "ä", "\n", "+", "(", "a@b", "9.9.9.9.9.9.9.9", "a@b.c_d@e.f", "00.01.002.255", "5500005555555559-1", "word"]
    texts = [(i, "".join(r.choices(parts, k=r.randint(0, 25)))) for i in range(1500)]
    texts += [(2000, "1" * 50_000), (2001, "a" * 50_000), (2002, "1 " * 30_000 + "2"), (2003, None), (2004, "")]
    path = str(tmp_path)
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    _check({x["doc_id"]: x for x in pii.op2_pii(spark, path).collect()}, texts)


def test_base_spans_agree_with_sql(spark):
    H.agrees(spark, pii.pii_base_spans, pii.BASE_ORACLE, H.SMALL)


def test_added_spans_against_brute_force(spark):
    """Every added span is a match of its kind's loose pattern by Python's matcher, at its place, passes its kind's checks, lies
    clear of base spans and of other added ones, and no clear match that scores enough is missing."""
    r = random.Random(9)
    parts = ["jane.doe (at) example (dot) com", "x[at]y[dot]org", "(415) 555-2671", "415-555-2671", "4111111111111111", "4111 1111 1111 1111", "Dr. Anna Weber", "Mr Smith", "a@b.org", "call",
             "phone", "card", "mail", "version", "1.2.3.4", "+49 30 1234567", "word", "12", ",", "."]
    texts = [(i, " ".join(r.choices(parts, k=r.randint(1, 12)))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    at = {d: t for d, t in texts}
    found = {}
    for x in pii.spans(docs, least=0.0).collect():
        found.setdefault(x["id"], []).append((pii.KINDS[x["kind"]], x["s"], x["e"], x["m"], x["base"], x["score"]))
    fine = {"card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and H.luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    for d, text in texts:
        mine = found.get(d, [])
        base = [(k, s, e) for k, s, e, _, b, _ in mine if b]
        assert sorted(f"{k}:{s}:{e}" for k, s, e in base) == sorted(H.base_spans(text))
        loose = [(kind, m.start(), m.end()) for kind, is_base, _, p in pii.PATTERNS if not is_base for m in re.finditer(p, text) if fine.get(kind, bool)(m[0])]
        clear = [x for x in loose if all(x[2] <= s or x[1] >= e for _, s, e in base)]
        added = [(k, s, e) for k, s, e, _, b, _ in mine if not b]
        assert set(added) <= set(clear) and all(at[d][s:e] == m for _, s, e, m, *_ in mine)
        for x in set(clear) - set(added):  # only one that another covers is left out
            assert any(x[1] < e and s < x[2] for _, s, e in added)
    strict = {(x["id"], x["s"]) for x in pii.spans(docs, least=0.9).filter("NOT base").collect()}
    assert strict == {(d, s) for d, xs in found.items() for k, s, e, m, b, score in xs if not b and score >= 0.9}


def test_loose_candidates_and_redaction(spark):
    rows = [
        (i, t) for i, t in enumerate((
            "Please write to jane.doe (at) example (dot) com today.",
            "Call me, my phone is (415) 555-2671 thanks.",
            "cards 4111111111111111 5500005555555559 on file",
            "An ordinary sentence, version 1.2 of 2020, page 3.",
            "mail a@b.org and b@c.org", None, "",
        ))
    ]
    docs = spark.createDataFrame(rows * 1, "doc_id long, text string")
    found = {(r["id"], pii.KINDS[r["kind"]], r["m"]) for r in pii.spans(docs, least=0.5).collect()}
    assert (0, "email", "jane.doe (at) example (dot) com") in found
    assert (2, "card", "4111111111111111") in found and (2, "card", "5500005555555559") in found
    assert not [f for f in found if f[0] in (3, 5, 6)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, least=0.5).collect()}
    assert clean[4] == "mail <email> and <email>"
    assert clean[3] == rows[3][1] and clean[5] is None and clean[6] == ""


def test_reliabilities_follow_the_agreeing_labelers():
    post = pii.reliabilities([(0, (1, 0, 1, 1, 0), 90), (0, (-1, -1, -1, 0, -1), 80), (0, (1, 0, -1, 0, 0), 5)])
    assert post[0, (1, 0, 1, 1, 0)] > 0.9 > 0.1 > post[0, (-1, -1, -1, 0, -1)]
    assert pii.reliabilities([]) == {}


def test_odd_rows(spark):
    docs = H.odd(spark, own=1, kind="x", s=2, e=3)
    assert pii.spans(docs).count() == 0
    assert pii.spans(H.empty(spark)).count() == 0
    assert pii.redact(docs).count() == len(H.odd_rows())
    clash = docs.withColumnsRenamed({"lang": "__own", "source": "__id", "own": "__spans"})
    assert pii.redact(clash).columns == clash.columns
    two = spark.createDataFrame([(1, "a@b.org"), (1, "a@b.org"), (None, "x c@d.org")], "doc_id long, text string")
    assert sorted(r["m"] for r in pii.spans(two).collect()) == ["a@b.org", "c@d.org"]
    assert sorted(r["text"] for r in pii.redact(two).collect()) == ["<email>", "<email>", "x <email>"]


def test_patterns_equal_the_plain_ones():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "card": r"[0-9](?:[\x20-]?[0-9])+"}
    text = "a@b.c_d@e.f x1-2 3@4.5"
    for kind, _, _, pattern in pii.PATTERNS[:3:2]:
        pattern = pattern.replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "")
        assert re.findall(pattern, text) == re.findall(plain[kind], text)
