"""Column functions for keys, times and command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit handle: the low halves of the 64-bit FNV-1a constants.
HASH_SEED = 0x84222325
HASH_FACTOR = 435
MASK = 0xFFFFFFFF

UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
LOG_LEVELS = ["off", "error", "warn", "info", "debug", "trace"]
SUBCOMMANDS = ["show", "explain", "stats", "plot", "config", "logs"]


def _bytes(data: Column) -> Column:
    digits = F.hex(data)
    pairs = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(pairs, lambda i: F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("long"))


def fnv_low(data: Column) -> Column:
    """The low 32 bits of FNV-1a over bytes; they never need the high half."""
    return F.aggregate(_bytes(data), F.lit(HASH_SEED).cast("long"), lambda h, b: (h.bitwiseXOR(b) * HASH_FACTOR).bitwiseAND(F.lit(MASK)))


def _address(argv: Column, cwd: Column, stdout: Column, stderr: Column) -> Column:
    nul = F.lit(b"\x00")
    words = F.aggregate(argv, F.lit(b""), lambda done, a: F.concat(done, a.cast("binary"), nul))
    return F.concat(words, cwd.cast("binary"), nul, stdout.cast("binary"), nul, stderr.cast("binary"))


def handle(argv: Column, cwd: Column, stdout: Column, stderr: Column) -> Column:
    """A run's short address for display: 8 hex digits over argv, cwd and both streams."""
    return F.lpad(F.lower(F.hex(fnv_low(_address(argv, cwd, stdout, stderr)))), 8, "0")


def run_key(argv: Column, cwd: Column, stdout: Column, stderr: Column) -> Column:
    """A run's key: SHA-256 of the same bytes, so that no two runs share one."""
    return F.sha2(_address(argv, cwd, stdout, stderr), 256)


def is_handle(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{8}\z")


def rfc3339(at: Column) -> Column:
    """UTC to the second; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def since_seconds(spec: Column) -> Column:
    """Seconds of ``7d``, ``24h``, ``30m`` or ``2w``; null where it isn't one."""
    shape = r"\A\+?([0-9]{1,12})([mhdw])\z"
    unit = F.regexp_extract(spec, shape, 2)
    scale = F.lit(None).cast("long")
    for name, seconds in UNIT_SECONDS.items():
        scale = F.when(unit == name, F.lit(seconds).cast("long")).otherwise(scale)
    return F.when(spec.rlike(shape), F.regexp_extract(spec, shape, 1).cast("long") * scale)


def since_cutoff(spec: Column, now: Column) -> Column:
    """``now`` less the duration, as RFC 3339."""
    return rfc3339(F.timestamp_seconds(F.unix_seconds(now) - since_seconds(spec)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def exit_code(code: Column, signal: Column) -> Column:
    """128 + signal where one ended the run; 1 where unknown or out of a byte."""
    mapped = F.when(signal.isNotNull(), signal + 128).otherwise(code)
    return F.when(mapped.between(0, 255), mapped).otherwise(1)


def level_rank(name: Column) -> Column:
    """Verbosity of a log level's name in any case; null for others."""
    low = F.lower(name)
    rank = F.lit(None).cast("int")
    for n, level in enumerate(LOG_LEVELS):
        rank = F.when(low == level, n).otherwise(rank)
    return rank


def view_level(text: Column) -> Column:
    """0 to 3, else null."""
    return F.when(text.rlike(r"\A[0-3]\z"), text.cast("int"))


def child_args(argv: Column) -> Column:
    """Arguments as given to the child: git is told not to page."""
    rest = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))
    return F.when(basename(F.element_at(argv, 1)) == "git", F.concat(F.array(F.lit("--no-pager")), rest)).otherwise(rest)


def scrub_env(env: Column, prefix: str) -> Column:
    """Environment without the tool's own variables."""
    return F.map_filter(env, lambda k, v: ~k.startswith(prefix))


def invocation(argv: Column) -> Column:
    """What a command line asks of the tool: run, subcommand, help, version or an error."""
    first = F.try_element_at(argv, F.lit(1))
    flag = first.startswith("-") & ~first.isin("-", "--")
    return (
        F.when(first.isNull(), "help")
        .when(first.isin("-h", "--help"), "help")
        .when(first.isin("-V", "--version"), "version")
        .when(flag, "unknown_flag")
        .when(first.isin(*SUBCOMMANDS), "subcommand")
        .otherwise("run")
    )
