"""Candidate segments of the personal-data field, and records of archives, against plain forms."""

import io
import random
import time

from corpusloom.llm import pii, warc


def plain(text):
    """Every stretch of at most so many tokens that a kind's pattern takes; an address ends in a letter or digit."""
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    out = set()
    for i, (a, _) in enumerate(tokens):
        for j, (_, b) in enumerate(tokens[i : i + pii.LONGEST], i + 1):
            out |= {(i, j, kind) for kind in range(4) if (kind or text[b - 1].isalnum()) and pii.span_features(text, a, b, kind) is not None}
    return out


def test_candidates_are_all_that_the_patterns_take():
    rng = random.Random(9)
    parts = ["12", "34", "1", "4111", "5.", "255", ".", "-", "(", ")", "+", " ", " ", "/", "@", "jo", "mail", " at ", "[at]", " [dot] ", "com", ".org", "\n", "²", "00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts.append("x" * 120 + "@example.org and " + "a_" * 5 + "b" * 200 + "@mail.example.com")
    for text in texts:
        assert {s[:3] for s in pii.candidates(text, 0, len(text))[1]} == plain(text), text


def test_an_address_may_be_long():
    text = "write to " + "a" * 100 + " [at] example [dot] org"
    assert any(s[2] == 0 for s in pii.candidates(text, 0, len(text))[1])


def test_large_records_take_linear_time():
    rng = random.Random(1)
    big = rng.randbytes(40 << 20)
    archive = b"".join(warc.record(k, "u", body, None) for k, body in enumerate((b"one", big, b"", warc.MAGIC * 1000)))
    begin = time.perf_counter()
    got = [warc.parse(raw)[1].partition(b"\r\n\r\n")[2] for raw in warc.records(io.BytesIO(archive), 0, len(archive))]
    assert got == [b"one", big, b"", warc.MAGIC * 1000]
    assert time.perf_counter() - begin < 10
