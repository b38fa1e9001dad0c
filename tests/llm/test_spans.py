"""Secrets and personal data against the plain patterns."""

import hashlib
import math
import random
import re

import pytest

from vekspar.llm import pii, secrets


def base_secrets(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, (p, n) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def base_pii(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_equal_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["password", "Token", "api_key", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef0123", "@", ".", "a.b", "4111 1111 1111 1111", "4111-1111", "+49 (30) 1234-567", "1.2.3.4", "256.1.1.1", "00", "7", "-", " ", "\n", "é", "ſecret", "IBAN", "DE89370400440532013000", "https://u:pw@h.de", "account no 12345678", "٣"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x for x in secrets.scan(text) if x[0] != "guess"] == base_secrets(text), text
        assert [x for x in pii.scan(text) if x[0] in pii.BASE] == base_pii(text), text


def test_guess_cost_ranks_values():
    cheap = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "welcome2024-01-02", "P@ssw0rd"]
    dear = ["x9Kq2vLm8ZtR", "tr0ub4dor&3zXq!", "f81d4fae7dec11d0"]
    assert max(map(secrets.guess_cost, cheap)) < secrets.MIN_COST < min(map(secrets.guess_cost, dear))
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("é" * 50_000) > 0


def brute_cost(value, card):
    """The least cost over all segmentations, by the plain definition of each segment's."""
    low = value.lower()

    def one(i, j):
        seg, out = value[i:j], [card] if j - i == 1 else []
        x = low[i:j]
        for w, more in ((x, 0), (x.translate(secrets._LEET), 0.5)):
            if j - i >= 3 and w in secrets._RANK and (more == 0 or x not in secrets._RANK):
                out.append(math.log10(secrets._RANK[w] + 10) + more + 0.5 * (seg != x))
        if secrets._DATE.fullmatch(seg):
            out.append(4.6 if j - i > 4 else 2.1)
        for p in range(1, min(secrets.PERIOD, (j - i) // 2) + 1):
            if j - i >= 3 and (j - i) % p == 0 and seg == seg[:p] * ((j - i) // p):
                out.append(brute_cost(seg[:p], card) + math.log10((j - i) // p))
        steps = {secrets._step(a, b) for a, b in zip(x, x[1:], strict=False)}
        if j - i >= 3 and len(steps) == 1 and None not in steps:
            out.append(1.6 + math.log10(j - i))
        return min(out, default=math.inf)

    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        best[j] = min(best[i] + one(i, j) for i in range(j))
    return best[-1]


def test_guess_cost_is_the_least_over_all_segmentations():
    rng = random.Random(3)
    parts = ["abc", "aaa", "qwe", "1qaz", "2024", "-05-06", "password", "P@ss", "x", "9", "zz", "admin", "7", "rty", "20240506", "poi"]
    for _ in range(400):
        v = "".join(rng.choice(parts) * rng.choice((1, 1, 2, 4)) for _ in range(rng.randrange(1, 5)))[:24]
        card = 1.5
        assert math.isclose(secrets._cost(v, card), brute_cost(v, card)), v


def test_patterned_values_are_cheap():
    for v in ("abcabcabcabc", "1qaz2wsx3edc", "documentation.html", "https://example.com/", "aaaaaaaaaaaaaaaaaaaaaaaa", "adminadminadmin"):
        assert secrets.guess_cost(v) < secrets.MIN_COST, v
    assert secrets.guess_cost("İ" * 30) >= 0  # lower() makes it longer


def test_context_values_are_added():
    text = "login is x9Kq2vLm8ZtR and pwd=password123 and password = x9Kq2vLm8ZtR"
    got = [text[s:e] for k, s, e in secrets.scan(text) if k == "guess"]
    assert got == ["x9Kq2vLm8ZtR", "x9Kq2vLm8ZtR"]
    assert secrets.redact(text, secrets.scan(text)) == "login is [secret] and pwd=password123 and [secret]"


def test_added_identifiers():
    text = "IBAN: DE89370400440532013000, ftp://joe:pw12@host.org/x, account no 12345678"
    kinds = {k: text[s:e] for k, s, e in pii.scan(text)}
    assert kinds["iban"] == "DE89370400440532013000" and kinds["login"].startswith("joe:pw12@") and kinds["account"] == "12345678"


def test_cues_and_addresses():
    of = lambda t, k: [t[s:e] for x, s, e in pii.scan(t) if x == k]
    assert of("account 2023-10-15, account no 12-345678, subaccount 99887766", "account") == ["12-345678"]
    text = "He lives at 221B Baker Street, London NW, or 12 Old Mill Road, Springfield, IL 62704. Hauptstraße 12a, 10115 Berlin; Calle de Alcalá 42; Main Street"
    assert of(text, "address") == ["221B Baker Street", "12 Old Mill Road, Springfield, IL 62704", "Hauptstraße 12a, 10115 Berlin", "Calle de Alcalá 42"]
    long = f"https://{'u' * 1000}:{'p' * 1000}@host.org/ and {'x://' * 50_000}"
    assert [len(x) for x in of(long, "login")] == [2010]


def test_queries_hold_every_row(spark, documents, nothing):
    for fn, other in ((secrets.scan_secrets, base_secrets), (pii.scan_pii, base_pii)):
        rows = fn(documents).collect()
        assert len(rows) == documents.count() and all(r.spans is not None for r in rows)
        assert fn(nothing).count() == 0
    masked = secrets.redact_secrets(documents)
    assert masked.columns == documents.columns and masked.count() == documents.count()


def test_query_digests(spark):
    from vekspar.llm import queries as q

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for fn, base in ((q.op8_secret_scans, base_secrets), (q.op9_pii_anchors, base_pii)):
        rows = fn(spark, sf).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(texts[r.doc_id])).encode()).hexdigest()
