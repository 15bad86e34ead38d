"""Column functions over single lines: cleaning, progress, severity, cost.

All are built-in expressions (regular expressions and higher-order functions), so they
stay on the JVM and can be evaluated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "silt"

SPACE = r"\p{IsWhite_Space}"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}_]"

# The lists that decide what a line is.
PROGRESS_VERBS = ["Compiling", "Downloading", "Downloaded", "Updating", "Fetching", "Installing", "Unpacking", "Resolving", "Building", "Waiting"]
DECORATION_WORDS = ["done", "complete", "completed", "of", "eta", "remaining"]
BAR_CHARACTERS = "#=-━─╾█░▒▓>[]|."
SPINNERS = "⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏◐◓◑◒"
FAILURE_WORDS = ["error", "errors", "failed", "failure", "failures", "panic", "panicked", "fatal", "abort", "aborted"]
TEST_FAILURE_WORDS = ["failed", "failures", "failing", "not ok"]
WARNING_WORDS = ["warning", "warnings", "warn", "deprecated", "deprecation"]
FAILURE_PHRASES = ["panicked at", "traceback (most recent call last)", "stack trace"]
SPLITTERS = "/\\:;|=<>{}[]()#@$%^&*+~`\""
RUN_PER_TOKEN = 5
BAR_LEAST = 8
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Parts that every line with a word of the lists holds, to pass over all other lines
# with plain substring searches.
FAILURE_PARTS = ["error", "fail", "panic", "fatal", "abort", "exception", "traceback", "stack trace"]
WARNING_PARTS = ["warn", "deprecat"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _set(characters: str) -> str:
    """A character class's inside with every ASCII punctuation mark escaped."""
    return "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in characters)


def trim(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def is_blank(text: Column) -> Column:
    return trim(text) == ""


# -- terminal escapes ------------------------------------------------------------------

ESCAPES = r"(?s)\x1b(?:\[[^@-~]*(?:[@-~]|\z)|\].*?(?:\x07|\x1b\\|\z)|[^\[\]]|\z)"


def strip_escapes(text: Column) -> Column:
    """Without escape sequences, and without control characters but tab and return."""
    return F.regexp_replace(F.regexp_replace(text, ESCAPES, ""), r"[\p{Cc}&&[^\t\r]]", "")


def apply_overwrites(text: Column) -> Column:
    """What a line shows after each carriage return lets later characters overwrite."""
    return F.aggregate(F.split(text, "\r", -1), F.lit(""), lambda shown, part: F.concat(part, shown.substr(F.length(part) + 1, F.length(shown))))


def clean(text: Column) -> Column:
    return apply_overwrites(strip_escapes(text))


def clean_line(text: Column) -> Column:
    """Cleaned only where there is an escape or a carriage return."""
    return F.when(text.contains("\x1b") | text.contains("\r"), clean(text)).otherwise(text)


# -- shape -----------------------------------------------------------------------------


def is_indented(text: Column) -> Column:
    return text.startswith(" ") | text.startswith("\t")


def is_gutter(text: Column) -> Column:
    """A numbered or bare margin of a diagnostic: digits, then ``|``, ``=``, ``^`` or ``...``."""
    return text.rlike(rf"\A[0-9]*{SPACE}*([\x7C=^]|\.\.\.)")


# -- progress --------------------------------------------------------------------------


def is_decoration(text: Column) -> Column:
    """Only numbers and the words that go with a percentage."""
    word = rf"(?i)\A{NOT_ALNUM}*(?:(?:{'|'.join(DECORATION_WORDS)})|[0-9](?:[0-9.]*[0-9])?)?{NOT_ALNUM}*\z"
    return F.forall(F.split(text, f"{SPACE}+"), lambda w: (w == "") | w.rlike(word))


def is_percentage(trimmed: Column) -> Column:
    shape = r"(?s)\A([^%]*?)[0-9.]+%(.*)\z"
    return trimmed.contains("%") & trimmed.rlike(shape) & is_decoration(F.regexp_extract(trimmed, shape, 1)) & is_decoration(F.regexp_extract(trimmed, shape, 2))


def is_bar(trimmed: Column) -> Column:
    """Drawn for three quarters, and so with three drawing characters together somewhere."""
    drawn = F.length(F.regexp_replace(trimmed, f"[^{_set(BAR_CHARACTERS)}]", ""))
    likely = (F.length(trimmed) >= BAR_LEAST) & trimmed.rlike(f"[{_set(BAR_CHARACTERS)}]{{3}}")
    # ``drawn`` stands once, or Spark would work it out for every line as a common part
    return likely & (drawn * 4 >= F.greatest(F.length(trimmed) * 3, F.lit(BAR_LEAST * 4)))


def is_progress(text: Column) -> Column:
    """A verb of progress, a percentage, a drawn bar or a spinner."""
    t = trim(text)
    verb = t.rlike(rf"(?s)\A({'|'.join(PROGRESS_VERBS)}) .")
    return (t != "") & (verb | is_percentage(t) | is_bar(t) | t.rlike(f"\\A[{SPINNERS}]"))


# -- severity --------------------------------------------------------------------------


def _reports(low: Column, words: list[str]) -> Column:
    """A word that opens the line, stands before a detail, or follows a count."""
    w = "|".join(words)
    start = low.rlike(rf"\A{SPACE}*({w})({NOT_WORD}|\z)")
    detail = low.rlike(rf"(\A|{NOT_ALNUM})({w})[:\[(]")
    return start | detail | low.rlike(rf"[0-9]{SPACE}+({w})")


def _holds(text: Column, parts: list[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def is_failure_line(text: Column) -> Column:
    low = lower_ascii(text)
    phrase = F.lit(False)
    for p in FAILURE_PHRASES:
        phrase = phrase | low.contains(p)
    named = low.rlike(rf"(?s)\A{SPACE}*[^\p{{IsWhite_Space}}]*(error|exception)[^\p{{IsWhite_Space}}]*:({SPACE}|\z)")
    return _holds(text, FAILURE_PARTS) & (phrase | named | _reports(low, FAILURE_WORDS))


def is_test_failure_line(text: Column) -> Column:
    low = lower_ascii(text)
    return low.rlike(rf"(\A|{NOT_WORD})({'|'.join(TEST_FAILURE_WORDS)})({NOT_WORD}|\z)") & low.contains("test")


def is_warning_line(text: Column) -> Column:
    return _holds(text, WARNING_PARTS) & _reports(lower_ascii(text), WARNING_WORDS)


def has_content(text: Column) -> Column:
    """Any letter or digit."""
    return text.rlike(ALNUM)


def classify_text(text: Column) -> Column:
    """The class of a block given as one text: its first failing line settles it."""
    lines = F.split(text, "\n", -1)
    failing = F.filter(lines, is_failure_line)
    return (
        F.when(F.size(failing) > 0, F.when(is_test_failure_line(F.element_at(failing, 1)), "Failure").otherwise("Error"))
        .when(F.exists(lines, is_warning_line), "Warning")
        .when(has_content(text), "Info")
        .otherwise("Noise")
    )


# -- cost ------------------------------------------------------------------------------


def normalise_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def token_estimate(text: Column) -> Column:
    """Letters and digits by runs of five, and one for each splitting character.

    Each run of up to five becomes one mark (which texts hold none of by then), what is
    neither mark nor splitter goes, and the rest is counted: no array is built.
    """
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), f"{ALNUM}{{1,{RUN_PER_TOKEN}}}", "\x01")
    return F.length(F.regexp_replace(marked, f"[^\x01{_set(SPLITTERS)}]", "")).cast("long")
