"""Secret scans with a randomness test battery (DataFrame functions only).

Base patterns find assignments, access keys and long hex runs. The method adds long tokens that
look like random bytes in an encoding inferred from their characters (hex, base32 and base36 in
either case, base62, base64, dashed UUIDs as hex). The parts of a token between slashes, and its
runs of letters and digits, are tokens too: a path or prefix does not hide a key behind it.

A span is a discovery: a token that ordinary text does not explain and the randomness tests do not
rule out.

* *Unlike text.* The null hypothesis is the text of the corpus itself, as a chain of letters and
  digits whose pair frequencies are counted over all its words. Under it the likelihood ratio of a
  uniform source against the chain exceeds x with probability 1/x at most, so the inverse of a
  token's ratio is a p-value. Tokens are discovered by the Benjamini-Hochberg rule at rate ``Q``
  within each (encoding, length band), over the distinct tokens of the corpus: of the discoveries at
  most a share ``Q`` is expected to be text.
* *Like random bytes.* On the symbols of the encoding a chi-squared test of the alphabet's uniformity, a
  runs test of symbols in the upper and lower half of the alphabet, and a test of serial correlation
  of neighbours, each against a uniform source, joined by Bonferroni to one p-value. A token is
  cleared, and so no span, where the same rule at rate ``Q`` says that it is not random.

Three passes over the texts. The first counts letter pairs (at most ``SYMBOLS`` squared numbers come to the
driver), the second gathers both p-values into grids of at most ``BINS`` counts per band; the limits
(two numbers per band) go back as literals, so the third pass needs no shuffle.

Work within a text grows as the number of its matches to the power 1.5 at most: positions are sums
over blocks, and overlaps are found by comparing with the spans before and after in order.

Defined cases: a null text counts as empty; texts without spans have empty span strings; repeated
rows are documents of their own; a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let, text_or_empty

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of 24 and more
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

MIN_TOKEN = 16
MIN_SYMBOLS = 3  # distinct; a repeated pair says nothing of an alphabet
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
_PART, _RUN = "[A-Za-z0-9+_-]", "[A-Za-z0-9]"
#: A token, its parts between slashes, and its runs of letters and digits are all candidates. The last two
#: take only what no pattern before them takes whole, so no span is found twice.
PARTS = (
    TOKEN,
    f"(?<!{_PART})(?:(?<=/){_PART}{{{MIN_TOKEN},}}+|{_PART}{{{MIN_TOKEN},}}+(?=/))",
    f"(?<!{_RUN})(?:(?<=[+_-]){_RUN}{{{MIN_TOKEN},}}+|{_RUN}{{{MIN_TOKEN},}}+(?=[+_-]))",
)
Q = 0.01
BINS, BINS_PER_DECADE = 1000, 50
LENGTH_BANDS = (16, 24, 32, 48, 96)
UUID = "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
_BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_BASE32 = string.ascii_uppercase + "234567"
ENCODINGS = {
    "hex": string.digits + "abcdef",
    "base32": _BASE32,
    "base36": string.digits + string.ascii_uppercase,
    "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": _BASE64,
}
#: The text model: letters (case folded) and digits, and one symbol for all others.
PLAIN = string.ascii_lowercase + string.digits
SYMBOLS = len(PLAIN) + 1
#: Pairs that the model assumes per symbol before it has seen a text.
PRIOR_PAIRS = 200
#: What a model without a text assumes: that a letter or digit is followed by its like, and that other
#: signs are rare.
AFTER_LETTER, AFTER_DIGIT, OTHER = 0.95, 0.9, 0.05
#: Names in mixed case begin their words with a capital: how likely text is to change case after a small
#: letter and after a capital.
TO_CAPITAL, TO_SMALL = 0.2, 0.75
#: Letters in a thousand letters of English text (fixed values).
LETTERS = {
    "e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28,
    "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 1.5, "x": 1.5, "q": 1, "z": 0.7,
}
#: No symbol is taken to be rarer than this after another: one odd pair makes no secret of a word.
LEAST = 1 / 2000
#: Columns that find_secrets adds (TEXT only on the way).
TEXT, BASE, RANDOM = "__secret_text", "__secret_base", "__secret_random"
KINDS = ("assign", "access", "hex", "random")


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running result over an int array: entry i combines the first i + 1 values. An aggregate that appends
    copies its list at each step, so it runs over blocks of about the square root of the length."""

    def walked(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            at = combine(state["at"], x)
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

        return F.aggregate(block, state, step, lambda state: state["out"])

    def cut(values: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
        last = F.floor((F.size(values) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, size))

    def joined(blocks: Column) -> Column:
        ends = walked(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, b: combine(a, b))), zero)
        return let(
            ends,
            lambda ends: F.flatten(
                F.transform(blocks, lambda x, i: walked(x, F.when(i > 0, F.get(ends, i - 1)).otherwise(zero)))
            ),
        )

    some = let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)))
    return F.coalesce(some, F.array().cast("array<int>"))


def _found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """start, rank, end, kind, value of each match, leftmost and not overlapping: the text between
    the matches and the matches themselves alternate, so their lengths add up to positions."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(matches)).alias("before"),
        matches.alias("match"),
        values.alias("value"),
    )

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.length(x["before"]) + F.length(x["match"]))
        ends = _running(lengths, lambda a, b: a + b, F.lit(0))
        return F.zip_with(
            pairs,
            ends,
            lambda x, end: F.struct(
                (end - F.length(x["match"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                end.alias("end"),
                F.lit(kind).alias("kind"),
                x["value"].alias("value"),
            ).cast(SPAN),
        )

    spans = let(pieces, placed)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def encoding_of(token: Column) -> Column:
    """The narrowest encoding whose alphabet holds a token. Letters of one case alone, and digits
    alone, count as base36, where what they lack tells words and numbers from keys. Other signs
    are base64 only beside both cases: else they join words or paths (see ``PARTS``)."""
    digit, lower, upper = (token.rlike(c) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    symbols = F.size(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")))
    mixed, varied = digit & (lower | upper), symbols >= MIN_SYMBOLS
    return (
        F.when(mixed & token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(varied & token.rlike(UUID), "hex")  # of its 32 digits
        .when(mixed & token.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)$"), "base32")
        .when(varied & token.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$"), "base36")
        .when(varied & token.rlike("^[A-Za-z0-9]+$"), "base62")
        .when(varied & lower & upper & token.rlike("^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$"), "base64")
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (rational approximation of erfc, absolute error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Fixed coefficients of the approximation.
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    series = functools.reduce(lambda acc, c: (acc + c) * t, reversed(terms), F.lit(0.0))
    tail = series * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column, encoding: Column) -> Column:
    """Combined p-value of a token under a uniform random source of its encoding."""
    plain = (
        F.when(encoding == "hex", F.translate(F.lower(token), "-", ""))
        .when(encoding.isin("base32", "base36"), F.upper(token))
        .otherwise(F.translate(token, "-_", "+/"))
    )
    alphabet = functools.reduce(
        lambda acc, e: F.when(encoding == e, F.lit(ENCODINGS[e])).otherwise(acc), ENCODINGS, F.lit("")
    )

    def coded(alphabet: Column) -> Column:
        symbols = F.filter(F.split(plain, ""), lambda c: c != "")
        codes = F.transform(symbols, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(codes, lambda x: _tests(x, F.length(alphabet).cast("double")))

    return let(alphabet, coded)


def _tests(codes: Column, k: Column) -> Column:
    n = F.size(codes).cast("double")
    zero = F.lit(0.0)
    # Equal codes lie together when sorted: a code that is met for the t-th time in a row adds 2 t - 1, so
    # t of them add up to t squared.
    start = F.struct(F.lit(-1.0).alias("code"), zero.alias("times"), zero.alias("sum"))

    def met(state: Column, c: Column) -> Column:
        times = F.when(state["code"] == c, state["times"] + 1).otherwise(F.lit(1.0))
        return F.struct(c.alias("code"), times.alias("times"), (state["sum"] + 2 * times - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(codes), start, met, lambda state: state["sum"])
    degrees = k - 1
    chi = k / n * squares - n
    spread = 2 / (9 * degrees)
    z_chi = (F.cbrt(F.greatest(chi, zero) / degrees) - (1 - spread)) / F.sqrt(spread)
    following = F.slice(codes, F.lit(2), F.size(codes))
    pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("a"), following.alias("b"))
    changes = F.aggregate(
        pairs, zero, lambda acc, x: acc + ((x["a"] >= k / 2) != (x["b"] >= k / 2)).cast("double")
    )
    z_runs = (changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    mean, variance = (k - 1) / 2, (k * k - 1) / 12
    products = F.aggregate(pairs, zero, lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
    z_serial = products / variance / F.sqrt(n - 1)
    least = F.least(
        _upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial))
    )
    return F.least(3 * least, F.lit(1.0))


def _band(length: Column) -> Column:
    return functools.reduce(
        lambda acc, low: F.when(length >= low, F.lit(low)).otherwise(acc), LENGTH_BANDS, F.lit(0)
    )


def pair_counts(texts: DataFrame) -> dict[str, int]:
    """How often letters and digits follow each other in the words of the corpus, and how often a word
    begins with each. The words of a token that is long enough to be a candidate are left out: they are
    what is judged. ``texts``: one column ``full_text``."""
    tokens = texts.select(F.explode(F.split(F.lower("full_text"), "[^a-z0-9+/_-]+")).alias("token"))
    distinct = tokens.filter(F.length("token") < MIN_TOKEN).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = distinct.select(F.explode(F.split("token", "[^a-z0-9]+")).alias("word"), "n").filter(F.length("word") > 0)
    pairs = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.when(i > 0, 2).otherwise(1)))
    rows = counted.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in rows.collect()}  # at most SYMBOLS squared


def text_model(counts: dict[str, int]) -> list[float]:
    """Logarithms of the probability of each symbol after each other, row by row; the last row is for the
    beginning of a token and after other signs, the last column for such signs."""
    letters = sum(LETTERS.values())

    def assumed(c: str, before: str) -> float:
        as_letter = AFTER_LETTER if not before.isdigit() else 1 - AFTER_DIGIT
        return as_letter * LETTERS[c] / letters if c.isalpha() else (1 - as_letter) / 10

    rows = []
    for before in [*PLAIN, ""]:
        seen = {c: counts.get(before + c, 0) for c in PLAIN}
        total = sum(seen.values()) + PRIOR_PAIRS
        shares = [(seen[c] + PRIOR_PAIRS * assumed(c, before)) / total * (1 - OTHER) for c in PLAIN]
        rows += [math.log(max(x, LEAST)) for x in [*shares, OTHER]]
    return rows


def log_ratio(token: Column, encoding: Column, model: list[float]) -> Column:
    """Logarithm of the likelihood ratio of a uniform source of the encoding against text. In an encoding
    with both cases text changes case as the words of a name do."""
    size = functools.reduce(
        lambda acc, e: F.when(encoding == e, F.lit(math.log(len(ENCODINGS[e])))).otherwise(acc), ENCODINGS, F.lit(0.0)
    )
    mixed = encoding.isin("base62", "base64")
    # Row by the case before (1 small, 2 capital, 0 neither), column by the case now.
    cases = [math.log(x) for x in (1, 0.5, 0.5, 1, 1 - TO_CAPITAL, TO_CAPITAL, 1, TO_SMALL, 1 - TO_SMALL)]
    plain = F.when(encoding == "hex", F.translate(token, "-", "")).otherwise(token)
    symbols = F.transform(
        F.filter(F.split(plain, ""), lambda c: c != ""),
        lambda c: F.struct(
            F.pmod(F.instr(F.lit(PLAIN), F.lower(c)) - 1, F.lit(SYMBOLS)).alias("code"),  # 0, not found, is the last
            F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(0).alias("case"),
        ),
    )
    before = F.array(F.struct(F.lit(SYMBOLS - 1).alias("code"), F.lit(0).alias("case")))

    def summed(symbols: Column, logs: list[float], row: int, field: str) -> Column:
        """Over neighbours: what ``logs`` has for the two."""
        rows = F.transform(symbols, lambda x: x[field])
        first = F.concat(F.transform(before, lambda x: x[field]), F.slice(rows, F.lit(1), F.size(rows) - 1))
        steps = F.zip_with(first, rows, lambda a, b: F.get(F.lit(logs), a * row + b))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)

    return let(
        symbols,
        lambda x: -F.size(x) * size
        - summed(x, model, SYMBOLS, "code")
        - F.when(mixed, summed(x, cases, 3, "case")).otherwise(0.0),
    )


def text_p(token: Column, encoding: Column, model: list[float]) -> Column:
    """p-value of a token under the hypothesis that it is text."""
    return F.exp(-F.greatest(log_ratio(token, encoding, model), F.lit(0.0)))


def step_up(bins: dict[int, int], q: float) -> float:
    """The largest p-value that the Benjamini-Hochberg rule rejects, from counts of p-values by bin of
    -log10 p. A bin stands for its upper edge, so the rate holds. 0 if nothing is rejected."""
    total, below, limit = sum(bins.values()), 0, 0.0
    for b in sorted(bins, reverse=True):
        below += bins[b]
        edge = 10 ** (-b / BINS_PER_DECADE)  # no p-value of this bin is above it
        if edge <= q * below / total:
            limit = max(limit, edge)
    return limit


#: (found, cleared) of an (encoding, length band): a token is a span if text explains it with a p-value of
#: at most the first and randomness with one above the second.
Limits = dict[tuple[str, int], tuple[float, float]]


def span_limits(texts: DataFrame, model: list[float], q: float = Q) -> Limits:
    """The limits of every band that has a token. ``texts``: one column ``full_text``. Two grids per band
    come to the driver."""
    tokens = texts.filter(F.col("full_text").rlike(TOKEN)).select(
        F.explode(
            F.concat(*[F.regexp_extract_all("full_text", F.lit(p), F.lit(0)) for p in PARTS])
        ).alias("token")
    )
    distinct = tokens.distinct().withColumn("encoding", encoding_of(F.col("token")))
    token, encoding = F.col("token"), F.col("encoding")

    def bin_of(p: Column) -> Column:
        return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-19))) * BINS_PER_DECADE), F.lit(BINS - 1))

    tests = F.array(
        *[
            F.struct(F.lit(name).alias("test"), bin_of(p).alias("bin"))
            for name, p in (("found", text_p(token, encoding, model)), ("cleared", battery(token, encoding)))
        ]
    )
    binned = distinct.filter(encoding.isNotNull()).select("encoding", _band(F.length("token")).alias("band"), F.explode(tests).alias("t"))
    grid = binned.groupBy("encoding", "band", "t.test", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[tuple[str, int], dict[str, dict[int, int]]] = {}
    for row in grid.collect():  # at most BINS rows per band and test
        counts.setdefault((row["encoding"], row["band"]), {}).setdefault(row["test"], {})[int(row["bin"])] = row["n"]
    return {band: (step_up(tests["found"], q), step_up(tests["cleared"], q)) for band, tests in counts.items()}


def _candidates(text: Column, limits: Limits, model: list[float]) -> Column:
    """Spans of the tokens that are discovered and not cleared."""
    found = [F.lit(x) for (e, b), (limit, _) in sorted(limits.items()) for x in (f"{e}:{b}", float(limit))]
    cleared = [F.lit(x) for (e, b), (_, limit) in sorted(limits.items()) for x in (f"{e}:{b}", float(limit))]
    if not found:
        return F.array().cast(f"array<{SPAN}>")

    def limit(of: list[Column], x: Column, missing: float) -> Column:
        key = F.concat_ws(":", x["encoding"], x["band"].cast("string"))
        return F.coalesce(F.try_element_at(F.create_map(*of), key), F.lit(missing))

    # Encoding and band are named once per token; the plan stays small.
    named = F.transform(
        F.concat(*[_found(text, p, "random") for p in PARTS]),
        lambda x: F.struct(
            x.alias("span"),
            encoding_of(x["value"]).alias("encoding"),
            _band(F.length(x["value"])).alias("band"),
        ),
    )

    def kept(x: Column) -> Column:
        token, encoding = x["span"]["value"], x["encoding"]
        return (
            encoding.isNotNull()
            & (text_p(token, encoding, model) <= limit(found, x, -1.0))
            & (battery(token, encoding) > limit(cleared, x, 1.0))
        )

    return F.transform(F.filter(named, kept), lambda x: x["span"])


def _outermost(spans: Column) -> Column:
    """Of spans that lie in each other or not at all, those that lie in no other."""

    def kept(ordered: Column) -> Column:
        reach = _running(F.transform(ordered, lambda x: x["end"]), F.greatest, F.lit(0))
        return let(reach, lambda r: F.filter(ordered, lambda x, i: (i == 0) | (x["end"] > F.get(r, i - 1))))

    by_start = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("wide"), x.alias("x")))
    ordered = F.transform(F.array_sort(by_start), lambda y: y["x"])
    return let(ordered, kept)


def _free(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the ``base`` spans (both sorted by start)."""

    def kept(both: Column) -> Column:
        # Marked and merged by start: what began before must have ended, what begins later must begin after.
        reach = _running(F.transform(both, lambda y: F.when(y["x"]["rank"] < 3, y["x"]["end"]).otherwise(0)), F.greatest, F.lit(0))
        turned = F.reverse(F.transform(both, lambda y: F.when(y["x"]["rank"] < 3, -y["x"]["start"]).otherwise(-(1 << 30))))
        ahead = F.reverse(_running(turned, F.greatest, F.lit(-(1 << 30))))

        def clear(r: Column) -> Column:
            return F.filter(
                both,
                lambda y, i: (y["x"]["rank"] == 3)
                & (F.get(r["reach"], i) <= y["x"]["start"])
                & (-F.get(r["ahead"], i) >= y["x"]["end"]),
            )

        free = let(F.struct(reach.alias("reach"), ahead.alias("ahead")), clear)
        return F.transform(free, lambda y: y["x"])

    marked = F.transform(F.concat(spans, base), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x.alias("x")))
    merged = let(F.array_sort(marked), kept)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), merged).otherwise(spans)


def _shown(spans: Column) -> Column:
    shown = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(shown, ",")


def find_secrets(documents: DataFrame, text_col: str = "text", q: float = Q) -> DataFrame:
    """``documents`` with two columns more, ``BASE`` and ``RANDOM``: arrays of spans (start, rank,
    end, kind, value) in code points, sorted by start, then kind."""
    documents = documents.withColumn(TEXT, text_or_empty(text_col))
    texts = documents.select(F.col(TEXT).alias("full_text"))
    model = text_model(pair_counts(texts))
    limits = span_limits(texts, model, q)
    text = F.col(TEXT)
    assign = F.filter(_found(text, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    access = F.filter(_found(text, ACCESS, "access"), lambda x: F.length(x["value"]) >= ACCESS_LENGTH)
    base = F.array_sort(F.concat(assign, access, _found(text, HEX, "hex")))
    found = documents.withColumn(BASE, base)
    random = let(_outermost(_candidates(text, limits, model)), lambda spans: _free(spans, F.col(BASE)))
    random = F.when(text.rlike(TOKEN), random)
    none = F.array().cast(f"array<{SPAN}>")
    return found.withColumn(RANDOM, F.coalesce(random, none)).drop(TEXT)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""

    def masked(ordered: Column) -> Column:
        reach = _running(F.transform(ordered, lambda x: x["end"]), F.greatest, F.lit(0))
        return let(reach, lambda reach: joined(ordered, reach))

    def joined(ordered: Column, reach: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            fresh = F.concat(F.substring(text, before + 1, x["start"] - before), F.lit(mark))
            return F.when((i == 0) | (x["start"] >= before), fresh).otherwise("")

        end = F.coalesce(F.try_element_at(reach, F.lit(-1)), F.lit(0))
        return F.concat(F.array_join(F.transform(ordered, piece), ""), F.substring(text, end + 1, F.length(text)))

    return let(F.array_sort(spans), masked)


def redact_secrets(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; every span of a text, base or random, becomes a mark, and
    ``n_chars``, where there is such a column, follows. Null and empty texts stay as they are, repeated
    rows are masked alike, an empty table stays empty."""
    found = find_secrets(documents, text_col)
    spans = F.concat(BASE, RANDOM)
    text = F.when(F.size(spans) > 0, redacted(F.col(text_col), spans)).otherwise(F.col(text_col))
    out = found.withColumn(text_col, text).drop(BASE, RANDOM)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(kind))
    return out.select(documents.columns)


def secret_digests(documents: DataFrame) -> DataFrame:
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = find_secrets(chosen)

    def number(kind: str) -> Column:
        return F.size(F.filter(BASE, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(_shown(F.col(BASE)), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat(BASE, RANDOM))).alias("spans"),
    )


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
