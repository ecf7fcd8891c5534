import math
import random
import re
import string
import time
from hashlib import sha256

import duckdb
import pandas as pd
import pytest

from statutegrid.llm import secret_scan as S

B64 = string.ascii_letters + string.digits + "+/"
SECRET = "wJalrXUtnFEMI8K7MDENGbPxRfiCYzK4"


def plain_spans(text):
    """All spans, each window counted anew."""
    text = text or ""
    ranked = []
    at = 0
    while m := re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)").search(text, at):
        if len(m[2]) >= 12:
            ranked.append((m.start(), 0, m.end(), "assign"))
        at = m.end()
    ranked += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    ranked += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for c in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(re.search(p, c[0]) for p in S.ALLOWED):
            continue
        for n, of in enumerate(S.CLASSES):
            hot = set()
            for i in range(c.start(), c.end() - of.window + 1):
                w = text[i : i + of.window]
                if not re.fullmatch(f"[{of.chars}]+", w):
                    continue
                entropy = -sum(w.count(x) / of.window * math.log2(w.count(x) / of.window) for x in set(w))
                if entropy >= of.bits - 1e-9 and len(re.findall("[0-9]", w)) >= of.least and len(re.findall("[A-Za-z]", w)) >= of.least:
                    hot |= set(range(i, i + of.window))
            runs = []
            for i in sorted(hot):
                if runs and runs[-1][1] == i and re.fullmatch(f"[{of.chars}]", text[i - 1]):
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
            ranked += [(s, 3 + n, e, of.name) for s, e in runs if not any(a <= s and e <= b for a, _, b, _ in ranked)]
    return [(k, s, e) for s, _, e, k in sorted(ranked)]


def noisy_texts(n, seed):
    rng = random.Random(seed)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    parts = [
        lambda: pick(string.ascii_lowercase, rng.randrange(1, 12)), lambda: pick(B64, rng.randrange(10, 70)), lambda: pick("0123456789abcdef", rng.randrange(8, 45)),
        lambda: pick("0123456789", rng.randrange(10, 30)), lambda: rng.choice(["token", "API_KEY", "Password", "secret"]) + rng.choice([": ", "=", '" = "', " "]) + pick(B64 + ".=", rng.randrange(5, 30)),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, rng.randrange(8, 20)), lambda: pick("aA1", 30), lambda: pick("0123456789ABCDEFabcdef", 40), lambda: "é\U0001f600ſecret: " + pick(B64, 14),
        lambda: "token=token=" + pick(B64, 10), lambda: "secret:ab token:" + pick(B64, 15), lambda: pick(B64 + "-_", 24) + "=" + pick("ab", 20) + pick(B64, 24),
    ]
    return [" ".join(rng.choice(parts)() for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_spans_equal_windows_counted_anew():
    scanner = S.Scanner()
    found = set()
    for text in noisy_texts(400, 1):
        spans = scanner.spans(text)
        assert spans == plain_spans(text)
        found |= {k for k, _, _ in spans}
    assert found == {"assign", "access", "hex", "hexadecimal", "alphanumeric", "base64"}


def test_sql_equals_the_operator_where_entropy_adds_spans(spark):
    texts = [*noisy_texts(150, 2), None, ""]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({S.SQL})").fetchall()}
    scanner = S.Scanner()
    for i, t in enumerate(texts):
        spans = scanner.spans(t)
        base = [x for x in spans if x[0] in S.BASE]
        assert base == S.base_spans(t or "")
        kinds = [k for k, _, _ in spans]
        assert want[i] == (*[kinds.count(k) for k in S.BASE], sha256(S.joined(base).encode()).hexdigest(), S.joined(spans)), t


@pytest.mark.parametrize("text", [
    "id 123e4567-e89b-12d3-a456-426614174000 of it", "sha256-n4bQgYhMfWWaL+qgxVrQFaO/TxsrC4Is0V1sFbDwCgg=", "see https/www/docs/2024/some-very-long-slug-with-words-2024", "AbCdefgh1234567890ijklmnopqrstu",
    "card 4111111111111111111111", "state-of-the-art-and-well-known-methods", "XXXXXXXXXXXX1234XXXXXXXXab", "thanbleshaningtionnt erberbeeinheitkeiter", "api-EXAMPLE-" + SECRET, "aaaaaaaaaaaaaaaaaaaa11aaaaaaaaaaaa",
])
def test_what_is_no_secret_gets_no_entropy_span(text):
    assert [x for x in S.Scanner().spans(text) if x[0] not in S.BASE] == []


def test_secrets_without_a_keyword_are_found_and_redacted():
    text = f"use {SECRET} or é {SECRET[::-1]}, not this."
    spans = S.Scanner().spans(text)
    assert [(k, text[s:e]) for k, s, e in spans] == [("alphanumeric", SECRET), ("alphanumeric", SECRET[::-1])]
    assert S.redacted(text, spans) == "use [secret] or é [secret], not this."
    assert S.redacted(None, []) is None
    inside = 'token = "0123456789abcdef0123456789abcdef"'
    assert S.joined(S.Scanner().spans(inside)) == "assign:0:41,hex:9:41" and S.redacted(inside, S.Scanner().spans(inside)) == '[secret]"'
    custom = S.Scanner(classes=(S.CharClass("letters", "a-z", 26, 4.5, 0),), allowed=())
    assert custom.spans("x " + string.ascii_lowercase) == [("letters", 2, 28)]


def test_odd_rows(spark, odd_docs, no_docs):
    scanner = S.Scanner()
    rows = S.scan(odd_docs).collect()
    assert len(rows) == 10 and [c for c in S.scan(odd_docs).columns] == [*odd_docs.columns, "secrets"]
    for r in rows:
        assert [tuple(x) for x in r["secrets"]] == scanner.spans(r["text"])
    assert S.scan(no_docs).count() == 0
    named = spark.createDataFrame([(f"a {SECRET}", "own", 1)], "`a.b` string, secrets string, `we``ird` int")
    got = S.scan(named, "a.b")
    assert got.columns == ["a.b", "we`ird", "secrets"] and len(got.first()["secrets"]) == 1
    assert S.without_secrets(named, "a.b").first()["a.b"] == "a [secret]"


def test_time_grows_with_the_text():
    scanner = S.Scanner()
    rng = random.Random(3)

    def took(n):
        text = " ".join("".join(rng.choice(B64) for _ in range(40)) + " " + "ab12" * 8 for _ in range(n))
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            scanner.spans(text)
            best = min(best, time.process_time() - began)
        return best

    assert took(4000) < 9 * took(1000)
