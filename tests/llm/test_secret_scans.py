from __future__ import annotations

import argparse
import base64
import hashlib
import math
import random
import re
import string
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm.secret_scans import (
    ENCODINGS, PARTS, PLAIN, SYMBOLS, UUID, battery, encoding_of, find_secrets, redact_secrets, secret_digests, text_model,
)
from tests.llm.helpers import ODD, by_id, documents, words

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


RNG = random.Random(11)
SECRETS = [base64.b64encode(RNG.randbytes(36)).decode() for _ in range(30)]
NAMES = ["".join(w.capitalize() for w in words(RNG, 9, 9)) for _ in range(30)]
LATE = "😀 ünï " * 3
ROWS = ODD + [
    (20, "token=token:abcdefgh"), (21, 'PassWord" : \'abc.def-ghi'), (22, "secret=abc secret=abcdef api_key:xx"),
    (23, LATE + "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 16), (24, LATE + "0123456789abcdef" * 3 + "g" + "a" * 23),
    (25, "x AKIA12 ffffffffffffffffffffffffgffffffffffffffffffffffff"), (26, "token = \"" + "9f" * 20 + "\" end"),
] + [(100 + i, f"{LATE} {s} end") for i, s in enumerate(SECRETS)] + [(200 + i, f"see {n} there") for i, n in enumerate(NAMES)]


def test_base_spans_match_brute_force(spark):
    got = by_id(secret_digests(documents(spark, ROWS)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = []
    for i, t in ROWS:
        spans = base(t)
        counts = [sum(k == kind for *_, k in spans) for kind in ("assign", "access", "hex")]
        want.append((i, *counts, hashlib.sha256(shown(spans).encode()).hexdigest()))
    assert [r[:5] for r in got] == sorted(want, key=repr)
    spans = {r[0]: r[5] for r in got}
    for i, t in ROWS:
        if i is not None and i < 100 and i != 5:
            assert spans[i] == shown(base(t))


def test_random_tokens_are_found_and_names_are_not(spark):
    spans = dict(by_id(secret_digests(documents(spark, ROWS)), "spans"))
    found = [i for i, s in enumerate(SECRETS) if spans[100 + i] == f"random:{len(LATE) + 1}:{len(LATE) + 1 + len(s)}"]
    assert len(found) >= 28
    assert sum("random" in spans[200 + i] for i in range(30)) <= 1


def brute_p(token, encoding):
    plain = token.lower() if encoding == "hex" else token
    codes = [ENCODINGS[encoding].index(c) for c in plain.translate(str.maketrans("-_", "+/"))]
    k, n = len(ENCODINGS[encoding]), len(codes)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    spread = 2 / (9 * (k - 1))
    z_chi = ((chi / (k - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)
    changes = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(codes, codes[1:]))
    z_runs = (changes - (n - 1) / 2) / (math.sqrt(n - 1) / 2)
    mean, var = (k - 1) / 2, (k * k - 1) / 12
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / var / math.sqrt(n - 1)
    return min(1.0, 3 * min(tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))


def test_battery_matches_brute_force(spark):
    tokens = SECRETS + [RNG.randbytes(20).hex().upper(), "0123456789abcdefabcdefabcdef", "A2" * 16, "Abc1" * 9, "aB3-_" * 6]
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("e", encoding_of(F.col("token")))
    for r in rows.withColumn("p", battery(F.col("token"), F.col("e"))).collect():
        assert r["p"] == pytest.approx(brute_p(r["token"], r["e"]), abs=2e-6), r


def test_encoding_is_inferred(spark):
    cases = {"a" * 30: None, "0" * 30: None, "0a" * 15: "hex", "0A" * 15: "hex", "K2" * 15: "base32", "aB3/" * 8: "base64",
             "aB3/_" * 8: None, "aB3-" * 8: "base64", "aB" * 15: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("e", encoding_of(F.col("t")))
    assert {r["t"]: r["e"] for r in rows.collect()} == cases


def key(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
KEYS = {
    "base36": [key(LOWER + DIGITS, 32) for _ in range(20)] + [key(UPPER + DIGITS, 32) for _ in range(20)],
    "base32": [key(LOWER + "234567", 32) for _ in range(20)], "base62": [key(LOWER + UPPER, 20) for _ in range(20)],
    "base64": [key(LOWER + UPPER + DIGITS + "+/", 20) for _ in range(20)], "hex": [str(uuid.UUID(bytes=RNG.randbytes(16), version=4)) for _ in range(20)],
}
HOOK, URL_SAFE = "com/services/T01/B02/", str.maketrans("+/", "-_")


@pytest.mark.parametrize("encoding", sorted(KEYS))
def test_keys_of_every_alphabet_are_found_also_behind_a_path(spark, encoding):
    keys = KEYS[encoding] if encoding != "hex" else KEYS["hex"] + [RNG.randbytes(9).hex() for _ in range(20)]
    rows = [(i, f"see {k} end") for i, k in enumerate(keys)] + [(100 + i, f"{HOOK}{k.translate(URL_SAFE)} end") for i, k in enumerate(keys)]
    spans = dict(by_id(secret_digests(documents(spark, rows)), "spans"))
    assert sum(spans[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys)) >= 0.9 * len(keys)
    end = [f":{len(HOOK) + len(k)}" for k in keys]
    assert sum(spans[100 + i].endswith(e) for i, e in enumerate(end)) >= 0.9 * len(keys)


def test_battery_folds_case_and_dashes(spark):
    rows = spark.createDataFrame([(t, e) for e in ("base36", "base32", "hex") for t in KEYS[e]], "token string, e string")
    for r in rows.withColumn("p", battery(F.col("token"), F.col("e"))).collect():
        plain = r["token"].replace("-", "") if r["e"] == "hex" else r["token"].upper()
        assert r["p"] == pytest.approx(brute_p(plain, r["e"]), abs=2e-6), r


def test_masking_leaves_no_base_span_and_all_rows(spark):
    docs = documents(spark, ROWS)
    masked = redact_secrets(docs)
    assert masked.columns == docs.columns
    got = masked.collect()
    assert len(got) == len(ROWS)
    assert not any(base(r["text"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[26]["text"] == '[SECRET]" end' and by[26]["n_chars"] == len('[SECRET]" end')
    assert by[8]["text"] == dict(ROWS)[8]
    assert by[1]["text"] is None


def test_empty_table(spark):
    assert find_secrets(documents(spark, [])).count() == 0


def brute_log_ratio(token, encoding, counts):
    """Uniform source against the chain of letters and digits, written out symbol by symbol."""
    size, mixed = len(ENCODINGS[encoding]), encoding in ("base62", "base64")
    plain = token.replace("-", "") if encoding == "hex" else token
    logs, before, case = text_model(counts), SYMBOLS - 1, 0
    total = 0.0
    for c in plain:
        code = PLAIN.find(c.lower()) if c.lower() in PLAIN else SYMBOLS - 1
        now = 1 if c.islower() else 2 if c.isupper() else 0
        chance = {(1, 1): 0.8, (1, 2): 0.2, (2, 1): 0.75, (2, 2): 0.25, (0, 1): 0.5, (0, 2): 0.5}.get((case, now), 1.0)
        total += math.log(1 / size) - logs[before * SYMBOLS + code] - (math.log(chance) if mixed else 0.0)
        before, case = code, now
    return total


def brute_encoding(t):
    if re.search("[0-9]", t) and re.search("[A-Za-z]", t):
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t):
            return "hex"
    varied = len(set(t)) >= 3
    if varied and re.fullmatch(UUID, t):
        return "hex"
    if re.search("[0-9]", t) and re.search("[A-Za-z]", t) and re.fullmatch("[A-Z2-7]+|[a-z2-7]+", t):
        return "base32"
    if varied and re.fullmatch("[A-Z0-9]+|[a-z0-9]+", t):
        return "base36"
    if varied and re.fullmatch("[A-Za-z0-9]+", t):
        return "base62"
    both = re.search("[a-z]", t) and re.search("[A-Z]", t)
    return "base64" if varied and both and re.fullmatch("[A-Za-z0-9+/]+|[A-Za-z0-9_-]+", t) else None


def brute_step_up(ps, q):
    """Benjamini-Hochberg on p-values rounded up to the grid."""
    up = sorted(10 ** (-min(math.floor(-math.log10(max(p, 1e-19)) * 50), 999) / 50) for p in ps)
    return max([p for i, p in enumerate(up, 1) if p <= q * max(j for j, x in enumerate(up, 1) if x == p) / len(up)], default=0.0)


def brute_random(rows):
    """Spans of the method per row, from the definition."""
    texts = [t or "" for _, t in rows]
    counts = Counter()
    for t in texts:
        short = [w for w in re.split("[^a-z0-9+/_-]+", t.lower()) if len(w) < 16]
        for w in re.split("[^a-z0-9]+", " ".join(short)):
            if w:
                counts[w[0]] += 1
                counts.update(w[i : i + 2] for i in range(len(w) - 1))
    found = [[(m.start(), m.end(), m[0]) for p in PARTS for m in re.finditer(p, t)] for t in texts]
    tokens = {x[2]: brute_encoding(x[2]) for spans in found for x in spans}
    band = lambda t: max(b for b in (16, 24, 32, 48, 96) if len(t) >= b)
    fold = lambda t, e: t.lower() if e == "hex" else t.upper() if e in ("base32", "base36") else t
    text = {t: math.exp(-max(brute_log_ratio(t, e, counts), 0.0)) for t, e in tokens.items() if e}
    noise = {t: brute_p(fold(t, e).replace("-", "") if e == "hex" else fold(t, e), e) for t, e in tokens.items() if e}
    groups = {}
    for t, e in tokens.items():
        if e:
            groups.setdefault((e, band(t)), []).append(t)
    limits = {g: (brute_step_up([text[t] for t in ts], 0.01), brute_step_up([noise[t] for t in ts], 0.01)) for g, ts in groups.items()}
    out = []
    for (_, t), spans in zip(rows, found):
        kept = []
        for a, b, token in spans:
            e = tokens[token]
            if e and text[token] <= limits[e, band(token)][0] and noise[token] > limits[e, band(token)][1]:
                kept.append((a, b))
        outer = [x for x in set(kept) if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in kept)]
        own = base(t)
        out.append(sorted(x for x in outer if not any(s < x[1] and x[0] < e for s, _, e, _ in own)))
    return out


#: English of some length: what the standard library says of itself.
PROSE = [w for m in (argparse, random, re, string, uuid) for x in [m, *vars(m).values()] for w in re.findall("[A-Za-z]+", getattr(x, "__doc__", None) or "")]
LONG_WORDS = ["Handelsgesellschaften", "internationalization", "einbereinachaukeit", "beberschlichkeitge", "getElementsByClassName", "snake_case_identifier_name",
              "docs/reference/configuration/index", "AbstractSingletonProxyFactoryBean", "2024-01-15-release-notes", "ACKNOWLEDGEMENTS", "user12345678901234567"]


def mixed_corpus():
    rng = random.Random(21)
    alphabets = [LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", "0123456789abcdef", LOWER + UPPER]
    rows = list(ODD)
    for i in range(160):
        w = [rng.choice(PROSE) for _ in range(60)] + rng.sample(LONG_WORDS, 2)
        if i % 4 == 0:
            w.append("".join(rng.choice(alphabets[i // 4 % 6]) for _ in range(rng.choice([16, 20, 26, 40, 100]))))
        if i % 12 == 0:
            w.append("https://x.org/a/" + "".join(rng.choice(LOWER + UPPER + DIGITS + "_-") for _ in range(30)))
        if i % 16 == 0:
            w.append("token=" + "".join(rng.choice(LOWER + DIGITS) for _ in range(30)))
        rng.shuffle(w)
        rows.append((1000 + i, " ".join(w)))
    return rows


def test_method_spans_match_brute_force(spark):
    rows = mixed_corpus()
    got = by_id(secret_digests(documents(spark, rows)), "spans")
    random_of = lambda s: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("random")]
    want = sorted(((i, tuple(x)) for (i, _), x in zip(rows, brute_random(rows))), key=repr)
    assert sorted(((i, tuple(random_of(s))) for i, s in got), key=repr) == want
    assert sum(bool(x) for _, x in want) > 30


def test_prose_is_no_secret_and_planted_keys_are(spark):
    rows = mixed_corpus()
    texts = dict(rows)
    found = set()
    for i, s in by_id(secret_digests(documents(spark, rows)), "spans"):
        for x in filter(None, s.split(",")):  # a long hex key is a base span
            a, b = map(int, x.split(":")[1:])
            found.add(texts[i][a:b])
    assert not {w for w in LONG_WORDS if any(w in x for x in found)}
    keys = {w for t in texts.values() if t for w in t.split() if len(w) >= 20 and w not in LONG_WORDS and not w.startswith(("token", "http", "x"))}
    keys = {k for k in keys if re.fullmatch("[A-Za-z0-9+/]{20,}", k)}
    assert len(keys) > 20 and len(keys & found) >= 0.9 * len(keys)


def test_a_long_text_of_tokens_takes_seconds(spark):
    rng = random.Random(3)
    text = " ".join(rng.randbytes(16).hex() for _ in range(15_000))
    began = time.time()
    row = secret_digests(documents(spark, [(1, text)])).first()
    assert row["n_hex"] == 15_000 and time.time() - began < 60
    masked = redact_secrets(documents(spark, [(1, text)])).first()["text"]
    assert masked == " ".join(["[SECRET]"] * 15_000)
