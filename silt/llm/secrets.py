"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

The patterns give the base spans. Beside them, every long token of base-64-like
characters that no base span overlaps is put to the battery. Its encoding is inferred as
the smallest alphabet it fits, and three tests ask whether its symbols could be uniform
random draws from it, each with the p-value of its own distribution: chi-squared
uniformity (chi-squared with as many degrees of freedom as the alphabet has symbols, less
one), the runs test above and below the alphabet's middle, and lag-one serial correlation
(both normal). Fisher's method combines them; a token whose combined p-value is under
``RANDOM`` is no random string.

A token that could be random could still be a word: short words are even enough. So the
chi-squared statistic is also held against its distribution in ordinary strings, whose
symbols are drawn as unevenly as English draws its letters: the chance of an ordinary
string being as even as the token is the p-value of calling it a secret. It is as large
for short tokens as their length makes it, and Benjamini-Hochberg controls the share of
false discoveries within each class of lengths. Nothing is learned from the corpus but
how many tokens were judged, so one key in one text is found, and as surely in any
corpus. The p-values are counted in steps of a twentieth of a power of ten, so the
statistics of any corpus are a table of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

# The patterns of the base spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Characters of a token that the battery judges, and the least number of them.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
TOKEN_CHARS = 20
#: Rate of false discoveries among the spans that the battery adds, and the least
#: combined p-value of a token that could be random.
FDR = 0.05
RANDOM = 0.01
#: Steps of a p-value to a power of ten, and how many are told apart.
STEPS = 20
LEVELS = 400
#: Length classes are powers of CLASS_BASE; the last holds all longer tokens.
CLASS_BASE = 1.25
CLASSES = 16

# Shares of the letters a to z in English text.
ENGLISH = [
    0.0817, 0.0149, 0.0278, 0.0425, 0.1270, 0.0223, 0.0202, 0.0609, 0.0697, 0.0015, 0.0077, 0.0403, 0.0241,
    0.0675, 0.0751, 0.0193, 0.0010, 0.0599, 0.0633, 0.0906, 0.0276, 0.0098, 0.0236, 0.0015, 0.0197, 0.0007,
]
#: The chance that two, and that three, symbols of an ordinary string agree.
AGREE_2, AGREE_3 = (sum(q**n for q in ENGLISH) for n in (2, 3))

# Alphabets, the smallest first.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("^[0-9A-Za-z_-]+$", DIGITS + UPPER + LOWER + "-_"),
]
ANY = DIGITS + UPPER + LOWER + "+/-_"

SPAN = "array<struct<s:int,e:int,m:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, kind: str, step) -> Column:
    """The array of what ``step`` gives for each item in turn, of type ``kind``.

    ``step(at, item)`` gives (what to keep, the next at); at is an int, 0 at first. Items
    are taken in blocks of about the root of their number, so that what is copied grows
    with its power of 1.5 and not with its square.
    """
    def one(acc: Column, x: Column) -> Column:
        keep, at = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], F.array(keep)).alias("out"))

    def many(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def all_of(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = _let(size, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(x, b * n + 1, n)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(x) == 0, F.array().cast(f"array<{kind}>")).otherwise(F.aggregate(blocks, start, many, lambda r: F.flatten(r["out"])))

    return _let(items, all_of)  # bound to a name: what a lambda holds is worked out on each call


def _located(text: Column, pattern: str) -> Column:
    """Spans (s, e, m) of leftmost non-overlapping matches: each begins as far behind the
    one before as the text between them, which splitting at the matches gives, is long."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), x["m"].alias("m")), e

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return _scan(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), "struct<s:int,e:int,m:string>", step)

    return _let(_matches(text, pattern), lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(placed(found)))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end, string) of each kind of base pattern, in code points.

    An assignment whose value is too short still uses up its characters, so all
    are located before the short ones are dropped; the other kinds' greedy runs cannot
    hide a longer match, so their least length is part of the pattern.
    """
    assign = F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= ASSIGN_VALUE)
    return {"assign": assign, "access": _located(text, ACCESS), "hex": _located(text, HEX)}


def _clear(base: Column, tokens: Column) -> Column:
    """The tokens that no base span overlaps.

    Both are gone through in order of their starts: forwards for the furthest end of
    the base spans before a token, backwards for the next start behind it.
    """
    kind = "struct<s:int,n:int,e:int,m:string>"
    tagged = lambda spans, n: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), (x["m"] if n else F.lit("")).alias("m")))
    far = 1 << 30
    keep = lambda x, fine: F.when((x["n"] == 0) | fine, x)
    forwards = _scan(F.array_sort(F.concat(tagged(base, 0), tagged(tokens, 1))), kind, lambda at, x: (keep(x, at <= x["s"]), F.when(x["n"] == 0, F.greatest(at, x["e"])).otherwise(at)))
    backwards = _scan(F.reverse(F.filter(forwards, lambda x: x.isNotNull())), kind, lambda at, x: (keep(x, far - at >= x["e"]), F.when(x["n"] == 0, F.greatest(at, far - x["s"])).otherwise(at)))
    left = F.reverse(F.filter(backwards, lambda x: x["n"] == 1))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(F.transform(left, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))


def _alphabet(token: Column) -> Column:
    alphabet = F.lit(ANY)
    for pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    return alphabet


def _tail(z: Column) -> Column:
    """The chance of a standard normal over ``z``, by a rational approximation."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, q).otherwise(1 - q)


def battery(token: Column) -> Column:
    """The tests' results: k, n, agree (pairs of equal symbols), and the p-values uniform,
    runs, serial, random (the three combined) and ordinary."""
    codes = lambda t, a: F.transform(F.split(t, ""), lambda c: F.call_function("instr", a, c).cast("double"))

    def counted(t: Column, a: Column) -> Column:
        k, n = F.length(a).cast("double"), F.length(t).cast("double")
        times = lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double")
        squares = F.aggregate(F.split(a, ""), F.lit(0.0), lambda acc, c: acc + F.when(c != "", _let(times(c), lambda x: x * x)).otherwise(F.lit(0.0)))
        half = (F.length(a) / 2).cast("int")
        sides = F.call_function("translate", t, a, F.concat(F.repeat(F.lit("L"), half), F.repeat(F.lit("H"), half)))
        x = F.filter(codes(t, a), lambda c: c > 0)
        middle = (k + 1) / 2
        products = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: (p - middle) * (q - middle))
        return F.struct(
            k.alias("k"), n.alias("n"), squares.alias("squares"), (n - F.length(F.replace(sides, F.lit("H"), F.lit("")))).alias("high"),
            F.length(F.regexp_replace(sides, "H+|L+", "x")).cast("double").alias("runs"),
            F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p).alias("products"),
        )

    def tested(c: Column) -> Column:
        k, n = c["k"], c["n"]
        free = k - 1
        ratio = F.greatest((c["squares"] * k / n - n) / free, F.lit(0.0))
        uniform = _tail((F.pow(ratio, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        mean = 2 * c["high"] * (n - c["high"]) / n
        spread = mean * (mean - 1) / (n - 1)
        runs = F.when(spread > 0, 2 * _tail(F.abs(c["runs"] - 1 - mean) / F.sqrt(spread))).otherwise(F.pow(F.lit(2.0), 1 - n))
        serial = 2 * _tail(F.abs(c["products"]) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
        # an alphabet smaller than English's is used as unevenly
        scale = F.greatest(26 / k, F.lit(1.0))
        two, three = AGREE_2 * scale, AGREE_3 * scale * scale
        agree, pairs = (c["squares"] - n) / 2, n * (n - 1) / 2
        deviation = F.sqrt(pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two))
        ordinary = _tail((pairs * two - agree) / deviation)
        return F.struct(k.alias("k"), n.alias("n"), agree.alias("agree"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), ordinary.alias("ordinary"))

    def combined(r: Column) -> Column:
        half = -(F.log(F.greatest(r["uniform"], F.lit(1e-300))) + F.log(F.greatest(r["runs"], F.lit(1e-300))) + F.log(F.greatest(r["serial"], F.lit(1e-300))))
        return F.struct(*(r[c].alias(c) for c in ("k", "n", "agree", "uniform", "runs", "serial", "ordinary")), (F.exp(-half) * (1 + half + half * half / 2)).alias("random"))

    return _let(F.struct(token.alias("t"), _alphabet(token).alias("a")), lambda x: _let(counted(x["t"], x["a"]), lambda c: _let(tested(c), combined)))


def _judged(tokens: Column) -> Column:
    """Tokens with their length class, and the steps of their p-value; 0 if not random."""

    def judge(t: Column) -> Column:
        size = (t["e"] - t["s"]).cast("double")
        group = F.least(F.floor(F.log(size / TOKEN_CHARS) / F.log(F.lit(CLASS_BASE)) + 1e-9), F.lit(CLASSES - 1)).cast("int")
        steps = lambda r: F.when(r["random"] >= RANDOM, F.least(F.floor(-F.log10(F.greatest(r["ordinary"], F.lit(1e-300))) * STEPS), F.lit(LEVELS))).otherwise(0).cast("int")
        return F.struct(t["s"].alias("s"), t["e"].alias("e"), group.alias("group"), _let(battery(t["m"]), steps).alias("level"))

    return F.transform(tokens, judge)


def limits(tokens: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The least level that passes in each length class, by Benjamini-Hochberg.

    ``tokens`` has group and level. Its counts are a table of at most CLASSES x
    (LEVELS + 1) rows, which is all that reaches the driver.
    """
    counts = {(r["group"], r["level"]): r["count"] for r in tokens.groupBy("group", "level").count().collect()}
    out = {}
    for group in {g for g, _ in counts}:
        judged, found = sum(n for (g, _), n in counts.items() if g == group), 0
        for level in range(LEVELS, 0, -1):
            found += counts.get((group, level), 0)
            if found and judged * 10 ** (-level / STEPS) <= fdr * found:
                out[group] = level
    return out


def _found(passed: dict[int, int]) -> Column:
    """Spans of the judged tokens at or over their class's level."""
    limit = F.array(*(F.lit(passed.get(g, LEVELS + 1)) for g in range(CLASSES)))
    return _bare(F.filter("tokens", lambda t: t["level"] >= F.element_at(limit, t["group"] + 1)))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _spans(rows: DataFrame, text: Column, keep: list[Column], label: str) -> DataFrame:
    """A written table of ``keep``, the base kinds' spans and the judged tokens of each text."""
    base = base_spans(text)
    found = rows.select(*keep, *(_bare(v).alias(k) for k, v in base.items()), _located(text, TOKEN).alias("tokens"))
    found = found.withColumn("tokens", _clear(F.concat(*base), F.col("tokens")))
    return materialize(found.withColumn("tokens", _judged(F.col("tokens"))), label)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, assign, access, hex, random): arrays of spans (s, e) of every row's text.

    Offsets are code points, ends exclusive. random holds the tokens that the battery
    finds and that no base span overlaps. Null and empty texts have no spans; rows with
    a null or repeated id are scanned like any other; an empty table gives no rows;
    other columns are ignored. The spans are written once, without the texts, so the
    corpus is read a single time for both its statistics and its result.
    """
    fresh(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _spans(rows, F.col("text"), [F.col("id")], "secret-spans")
    passed = limits(found.select(F.explode("tokens").alias("t")).select("t.*"), fdr)
    return found.select(F.col("id").alias(id_col), "assign", "access", "hex", _found(passed).alias("random"))


KINDS = ["assign", "access", "hex", "random"]


def joined(kinds: list[str] = KINDS) -> Column:
    """kind:start:end of all spans, by start, then kind as listed, comma-joined."""

    def tagged(number: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("n"), x["e"].alias("e"), F.lit(kind).alias("k")))

    each = [tagged(n, k) for n, k in enumerate(kinds)]
    lines = F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(lines, ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; other texts unchanged.

    Null and empty texts stay as they are. The rows are written once with the spans of
    their texts, limits are learned from all of them, and each text is cut at its own
    spans: no join, so null and repeated ids are no matter, nor are other columns' names.
    An empty table gives no rows.
    """
    fresh(docs, id_col, text_col)
    whole = docs.select(F.struct(*(F.col(_quoted(c)).alias(c) for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    found = _spans(whole, text, [F.col("row")], "secret-rows")
    passed = limits(found.select(F.explode("tokens").alias("t")).select("t.*"), fdr)
    spans = found.select("row", F.array_sort(F.concat("assign", "access", "hex", _found(passed))).alias("spans"))
    old = F.col("row").getField(text_col)
    new = F.when(F.size("spans") > 0, _cut(old, F.col("spans"), mark)).otherwise(old)
    return spans.select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each stretch that sorted spans cover.

    The gaps between the stretches are taken from blocks of the text, so that no gap
    is counted off from the text's beginning.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.struct(at.cast("int").alias("s"), x["s"].cast("int").alias("e"))
        return F.when(x["s"] >= at, gap), F.greatest(at, x["e"])

    def pieces(gaps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(gaps))).cast("int")
        first, last = lambda block: block[0]["s"], lambda block: F.element_at(block, -1)["e"]
        part = lambda block: _let(F.call_function("substring", text, first(block) + 1, last(block) - first(block)), lambda p: F.transform(block, lambda g: F.call_function("substring", p, g["s"] - first(block) + 1, g["e"] - g["s"])))
        return F.flatten(F.transform(F.sequence(F.lit(0), ((F.size(gaps) - 1) / size).cast("int")), lambda b: _let(F.slice(gaps, b * size + 1, size), part)))

    end = F.aggregate(spans, F.lit(0), lambda at, x: F.greatest(at, x["e"]))
    gaps = F.filter(_scan(spans, "struct<s:int,e:int>", step), lambda g: g.isNotNull())
    tail = _let(end, lambda e: F.call_function("substring", text, e + 1, F.length(text)))
    return F.concat(F.array_join(_let(gaps, pieces), mark), F.lit(mark), tail)
