"""What to do with a command line: capture its output, or pass it through and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.functions.scalars import basename

# Commands and flags by what they do to a terminal.
ALWAYS_INTERACTIVE = ["vi", "vim", "nvim", "emacs", "nano", "pico", "ed", "less", "more", "top", "htop", "btop", "ssh", "sftp", "telnet", "tmux", "screen", "man", "watch", "gdb", "lldb", "fzf"]
REPLS = ["python", "python3", "node", "irb", "psql", "mysql", "sqlite3", "redis-cli"]
GIT_EDITORS = ["commit", "rebase", "merge", "citool", "gui"]
GIT_PATCHES = ["add", "checkout", "restore", "reset", "stash", "commit"]
GIT_PROMPTS = ["rebase", "add", "clean"]
GIT_MACHINE_FLAGS = ["--porcelain", "-z", "--name-only", "--name-status", "--numstat", "--raw"]
MACHINE_FLAGS = ["--json", "--output=json", "--quiet", "-q"]
GIT_MACHINE_PREFIXES = ["--format=", "--pretty="]


def _args(argv: Column) -> Column:
    return F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))


def _any(args: Column, flags: list[str]) -> Column:
    return F.arrays_overlap(args, F.array(*(F.lit(f) for f in flags)))


def is_interactive(argv: Column, tty: Column) -> Column:
    """Whether the command would take over the terminal."""
    command, args = basename(F.element_at(argv, 1)), _args(argv)
    words = F.filter(args, lambda a: ~a.startswith("-"))
    sub = F.try_element_at(words, F.lit(1))
    editor = tty & sub.isin(*GIT_EDITORS)
    patch = sub.isin(*GIT_PATCHES) & _any(args, ["-p", "--patch"])
    prompt = sub.isin(*GIT_PROMPTS) & _any(args, ["-i", "--interactive"])
    git = sub.isNotNull() & (editor | patch | prompt)
    return F.when(command.isin(*ALWAYS_INTERACTIVE), True).when(command.isin(*REPLS), F.size(words) == 0).when(command == "git", F.coalesce(git, F.lit(False))).otherwise(False)


def is_machine_readable(argv: Column) -> Column:
    """Whether a flag asks for output that is meant to be parsed."""
    args = _args(argv)
    prefixed = F.lit(False)
    for p in GIT_MACHINE_PREFIXES:
        prefixed = prefixed | F.exists(args, _starts(p))
    git = (basename(F.element_at(argv, 1)) == "git") & (_any(args, GIT_MACHINE_FLAGS) | prefixed)
    return _any(args, MACHINE_FLAGS) | git


def _starts(prefix: str):
    return lambda a: a.startswith(prefix)


def plan(commands: DataFrame, executables: DataFrame) -> DataFrame:
    """``commands`` (argv, tty, raw) with action, program and reason.

    ``executables`` is the searched path: (name, dir_rank, dir, own), own for the tool
    itself; a qualified name is looked up by its whole path (name holds it, dir null).
    The lowest rank wins; entries of an empty directory are skipped. Reasons in order:
    mode_raw, interactive, machine_readable_flag, not_found, self_reference.
    """
    usable = executables.where("dir is null or dir <> ''")
    place = F.when(F.col("dir").isNull(), F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    found = usable.groupBy("name").agg(F.min_by(F.struct(place.alias("program"), "own"), "dir_rank").alias("_found"))
    argv = F.col("argv")
    rows = commands.withColumn("_name", F.element_at(argv, 1)).join(found.withColumnRenamed("name", "_name"), "_name", "left")
    reason = (
        F.when(F.col("raw"), "mode_raw")
        .when(is_interactive(argv, F.col("tty")), "interactive")
        .when(is_machine_readable(argv), "machine_readable_flag")
        .when(F.col("_found").isNull(), "not_found")
        .when(F.col("_found.own"), "self_reference")
    )
    rows = rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "capture").otherwise("passthrough"))
    return rows.withColumn("program", F.when(F.col("reason").isNull(), F.col("_found.program"))).drop("_name", "_found")
