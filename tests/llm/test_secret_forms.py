"""Forms in which keys and tokens stand in env files, JSON and headers."""

import base64
import hashlib
import random
import re

import pytest
from test_llm import der, integer

from sparsewell.llm import secrets

KEY = base64.b64encode(der(b"\x02\x01\x00", *[integer(40)] * 7, b"\x02\x28" + b"\x01" + b"\xff" * 39)).decode()
LINES = [KEY[k : k + 64] for k in range(0, len(KEY), 64)]


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def armoured(end, key=LINES, label="PRIVATE KEY", head=""):
    return f"-----BEGIN {label}-----{end}{head}{end.join(key)}{end}-----END {label}-----"


BODY = url64(b'{"sub":"1"}')
FORMS = {
    "equals sign": ("PRIVATE_KEY=", KEY, "\n", "der"),
    "colon": ("PRIVATE_KEY: ", KEY, "\n", "der"),
    "bare run after an escaped line end": ('"k\\n', KEY, '"', "der"),
    "plain lines": ("", armoured("\n"), "", "pem"),
    "escaped lines": ('{"k": "', armoured("\\n"), '\\n"}', "pem"),
    "escaped carriage returns": ("K='", armoured("\\r\\n"), "'", "pem"),
    "escaped twice": ('"{\\"k\\": \\"', armoured("\\\\n"), '\\"}"', "pem"),
    "escaped slashes": ('{"k": "', armoured("\\n", [x.replace("/", "\\/") for x in LINES]), '"}', "pem"),
    "one escaped line": ("K=", armoured("\\n", [KEY]), "", "pem"),
    "legacy header": ("", armoured("\\n", [url64(b"0" * 48)], "RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\\nDEK-Info: AES-128-CBC,00AA\\n\\n"), "", "pem"),
    "compact header": ("t ", f'{url64(b"""{"alg":"HS256"}""")}.{BODY}.sig', " y", "jwt"),
    "spaced header": ("t ", f'{url64(b"""{ "alg": "HS256" }""")}.{BODY}.sig', " y", "jwt"),
    "header on lines": ("t ", f'{url64(b"""{\n "alg": "HS256" }""")}.{BODY}.sig', " y", "jwt"),
    "leading space": ("t ", f'{url64(b""" {"alg":"HS256"}""")}.{BODY}.sig', " y", "jwt"),
    "lines of a block": ("key: |\n  ", "\n  ".join(LINES), "\nnext: value", "der"),
    "lines before text": ("", "\r\n".join(LINES), "\r\nMore words", "der"),
    "base64url": ("K=", url64(base64.b64decode(KEY)), "\n", "der"),
    "colons": ("priv: ", ":".join(f"{b:02X}" for b in base64.b64decode(KEY)), ".", "der"),
    "colons on lines": ("priv:\n    ", ":\n    ".join(":".join(f"{b:02x}" for b in base64.b64decode(KEY)[k : k + 15]) for k in range(0, len(base64.b64decode(KEY)), 15)), "\n", "der"),
    "behind other segments": ("www.example.", f'{url64(b"""{ "alg": "HS256" }""")}.{BODY}.sig', " y", "jwt"),
}


@pytest.mark.parametrize("name", FORMS)
def test_form_is_found_and_masked(name):
    before, secret, after, kind = FORMS[name]
    text = before + secret + after
    spans = [s for s in secrets.find_secrets(text) if s.order >= len(secrets.BASE_KINDS)]
    assert [(s.kind, s.start, s.end) for s in spans] == [(kind, len(before), len(before) + len(secret))]
    assert secrets.redact(text, spans) == before + "[SECRET]" + after


def test_other_forms_are_not_found():
    unsigned = f'{url64(b"""{ "alg": "none" }""")}.{BODY}.'
    letters = "A" * 64
    for text in (unsigned, f"{unsigned} y", armoured("\n", [letters], head="note: hello\n\n"), armoured("\n", [letters], head="Proc-Type: 4,ENCRYPTED\n\n"), "www.example.org", f"K={KEY[:-8]}", armoured("\\n", LINES[:-1]), armoured("\\x"), f"{url64(b'[1]')}.{BODY}.sig", f"{url64(b'{ }')}.{BODY}.sig", "\n".join(LINES[:-1]), "\n\n".join(LINES), url64(base64.b64decode(KEY))[:-4], ":".join(f"{b:02x}" for b in base64.b64decode(KEY)[:-1]), "30:" * 40 + "30"):
        assert not [s for s in secrets.find_secrets(text) if s.order >= len(secrets.BASE_KINDS)], text


def test_repeated_headers_take_linear_time():
    import time

    unit = "-----BEGIN PRIVATE KEY-----"
    texts = [unit * 40_000, (unit + "\nabc\n") * 40_000, "-" * 1_000_000, (armoured("\n") + "\n") * 2000, "eyJ." * 250_000, "token " * 160_000, "AKIA" * 250_000, KEY * 5000]
    for text in texts:
        began = time.process_time()
        spans = secrets.find_secrets(text)
        assert time.process_time() - began < 5 and len(spans) in (0, 1, 2000), text[:40]


def literal_spans(text):
    """The three base kinds by the contract's patterns, hits that are too short dropped afterwards."""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_literal_patterns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rnd = random.Random(8)
    bits = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "x.-/", "\n"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(4000)]
    planted = 0
    for text in [r.text or "" for r in rows] + made:
        want = literal_spans(text)
        assert [tuple(s) for s in map(lambda s: (s.start, s.order, s.end), secrets.find_secrets(text)) if s[1] < 3] == want
        planted += len(want)
    assert planted > 1000
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for r in rows:
        want = literal_spans(r.text or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_planted_structures_and_their_truncated_twins(spark):
    """Each structure stands in a text of the table and is found where it stands; cut short, it is not."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(len(FORMS) * 2).collect()
    docs, want = [], {}
    for k, (name, (before, secret, after, kind)) in enumerate(FORMS.items()):
        text = rows[2 * k].text or ""
        docs.append((2 * k, f"{text}\n{before}{secret}{after}\n{text}"))
        at = len(text) + 1 + len(before)
        want[2 * k] = f"{kind}:{at}:{at + len(secret)}"
        cut = secret[: len(secret) // 3]
        docs.append((2 * k + 1, f"{text}\n{before}{cut}{after}\n{text}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        structured = [s for s in r.spans.split(",") if s and s.split(":")[0] not in secrets.BASE_KINDS]
        assert structured == ([want[r.doc_id]] if r.doc_id in want else []), r.doc_id
