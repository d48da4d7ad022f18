"""Secret scans against plain regular expressions, and format inference."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from panelcast.llm import secrets

PATTERNS = (
    (
        "assign",
        r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]+)", 32),
)


def brute(text):
    found = []
    for order, (kind, pattern, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(1)) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def hexes(rng, n=40):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def texts():
    rng = random.Random(3)
    out = [None, "", "é token = \"" + hexes(rng) + "\" ß", "Password:short", "API_KEY='aaaaaaaaa'"]
    out += ["token=token=abcdefghijk", "ſecret=abcdefghijk", "AKIA" + "Z9" * 8, "xAKIAAKIAABC", hexes(rng, 31)]
    out += ["sECRET = \"" + "ab+/" * 9000 + "\"", "apikey:::abcdefgh12"]
    out += [f"note {i} token: {hexes(rng)} end" for i in range(60)]
    out += [f"see mail{i}.example.com.server{i % 7} and 2024-01-{i:02d}T00.00" for i in range(60)]
    return out


def test_base_spans_follow_the_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string").withColumn("spans", F.lit(1))
    model = secrets.infer_formats(docs)
    found = secrets.scan_secrets(docs, model, keep=["spans"]).collect()
    assert len(found) == len(rows) + 1
    text = dict(rows)
    for r in found:
        assert r["base_spans"] == brute(text[r["doc_id"]])
        assert r["n_hex"] == r["base_spans"].count("hex:")
        assert set(r["base_spans"].split(",")) <= set(r["spans"].split(",")) | {""}


def test_inferred_format_finds_unlabelled_strings_and_spares_others(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    model = secrets.infer_formats(docs)
    plain = ["mail3.example.com.server5", "2024-01-09T00.00.00"]
    assert (model.ratio([hexes(rng, 30)]) >= secrets.LIMIT).all()
    assert (model.ratio(plain) < 0).all()
    short = hexes(rng, 30)
    new = spark.createDataFrame([(1, f"left {short} right mail3.example.com.server5")], "doc_id bigint, text string")
    (row,) = secrets.scan_secrets(new, model, redact="[X]").collect()
    assert row["spans"] == "format:5:35"
    assert row["redacted"] == "left [X] right mail3.example.com.server5"


def test_automaton_merges_repeats_into_a_loop():
    automaton = secrets.infer(["0a" * n for n in range(8, 20)] * 20)
    assert len(automaton.step) < 20
    good, bad = secrets.likelihood(automaton, ["0a" * 12, "a0" * 12])
    assert good > bad


def test_nothing_labelled_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "plain text")], "doc_id bigint, text string")
    for table in (docs, docs.filter(F.lit(False))):
        model = secrets.infer_formats(table)
        assert all(r["spans"] == "" for r in secrets.scan_secrets(docs, model).collect())
    assert secrets.scan_secrets(docs.filter(F.lit(False)), model).count() == 0


def brute_candidates(text):
    """Runs of credential characters apart from the base spans, character by character."""
    covered = set()
    for span in filter(None, brute(text).split(",")):
        _, a, b = span.split(":")
        covered |= set(range(int(a), int(b)))
    found, start = [], None
    for i in range(len(text) + 1):
        inside = i < len(text) and i not in covered and re.fullmatch(r"(?a)[A-Za-z0-9+/_.=-]", text[i])
        if inside and start is None:
            start = i
        if not inside and start is not None:
            if i - start >= 8:
                found.append((start, i))
            start = None
    return found


def test_every_candidate_is_scored(spark):
    rng = random.Random(5)
    rows = texts()
    model = secrets.infer_formats(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    rows += [f"{hexes(rng, n)} and x-{hexes(rng, n)}-y" for n in range(6, 40)]
    rows += [f"{hexes(rng)}.mail/{hexes(rng, 12)} GHIJKLMN{hexes(rng)}zzzzzzzzz", "plainwords only here", "a" * 70_000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    seen = 0
    for r in secrets.scan_secrets(docs, model).collect():
        text = rows[r["doc_id"]] or ""
        parts = [(a, b) for a, b in brute_candidates(text)]
        high = model.ratio([text[a:b] for a, b in parts]) >= secrets.LIMIT
        want = {f"format:{a}:{b}" for (a, b), h in zip(parts, high) if h}
        got = set(filter(None, r["spans"].split(",")))
        assert got == want | set(filter(None, brute(text).split(",")))
        seen += len(want)
    assert seen >= 20
