import hashlib
import re

import pytest

from tracewell.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda n=number: 14 <= len(n) <= 19 and luhn(n), "phone": lambda n=number: 10 <= len(n) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


CASES = [
    None, "", "no data", "mail a.b+c@d-e.example.com, x", "a@b.c_d@e.f", "a@b.c@d.e", "@x.y a@b a@.b", "a@b.c..d", "😀 é u@v.w 😀",
    "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 007.1.02.3 1.2.3", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111x",
    "41111111111111111111 0", "4111111111111111", "card 4222222222222", "378282246310005 and 6011 0009 9013 9424  5105105105105100", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+1 (988) 555-2485 orthen", "+1 ( ((( 2", "++49.30.1234567-", "+123456789 +1234567890123456", "\u0001u@v.w\u0001 1.1.1.1\u0001", "9" * 5000, "1." * 3000, "a." * 4000 + "@", "a@" + "b.c" * 3000,
    "IBAN DE89 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "GB83WEST12345698765432", "social security 123-45-6789", "order 123-45-6789", "call 555-123-4567 now", "555-123-4567", "tel +1 555-123-4567",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(CASES)], "doc_id long, text string, t string, email int")
    return {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}


def test_base_spans_equal_brute_force(found):
    for i, text in enumerate(CASES):
        want = base(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert found[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (text or "")[:60]
        assert [found[i][f"n_{k}"] for k in KINDS] == [sum(k == x[2] for x in want) for k in KINDS]
        assert set(filter(None, listed.split(","))) <= set(found[i].spans.split(","))


def test_further_kinds_need_checksum_or_context(found):
    spans = {CASES[i]: r.spans for i, r in found.items() if CASES[i]}
    assert "iban" in spans["IBAN DE89 3704 0044 0532 0130 00 ok"] and "iban" in spans["GB82WEST12345698765432"]
    assert "iban" not in spans["GB83WEST12345698765432"]
    assert "ssn" in spans["social security 123-45-6789"] and not spans["order 123-45-6789"]
    assert "national" in spans["call 555-123-4567 now"] and not spans["555-123-4567"]


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert [r.n_email for r in pii.digest(pii.find(docs)).collect()] == [1, 1, 1]
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def test_very_many_matches_take_their_length_and_keep_their_places(spark):
    """Twenty thousand addresses in one text: positions beyond the first chunks are right, in seconds."""
    import time

    text = " ".join(f"m{i}@x.example" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    (r,) = pii.digest(pii.find(docs)).collect()
    assert r.n_email == 20_000 and time.monotonic() - began < 60
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base(text))
    assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_words_after_an_account_number_do_not_hide_it(spark):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB82 WEST 1234 5698 7654 32 12 May", "iban DE89370400440532013000"]
    got = [r.spans for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert [s.split(",")[0] for s in got] == ["iban:0:27", "iban:0:27", "iban:5:27"]
