"""Runs of commands, made on the executors.

Each command is one row; its two streams are read to their end, apart from each other.
"""

from __future__ import annotations

import subprocess
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from silt.session import python_workers

RUN = "argv array<string>, cwd string, stdout binary, stderr binary, exit_code int, duration_ms long"


def child(argv: list[str]) -> list[str]:
    """The command as it is started: git is told not to page."""
    return [argv[0], "--no-pager", *argv[1:]] if argv[0].rpartition("/")[2] == "git" else argv


def capture(argv: list[str], cwd: str | None = None) -> tuple[bytes, bytes, int, int]:
    """stdout, stderr, exit code (128 + signal where one ended it) and milliseconds."""
    began = time.monotonic()
    run = subprocess.Popen(child(argv), cwd=cwd, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    err: list[bytes] = []
    reader = threading.Thread(target=lambda: err.append(run.stderr.read()))
    reader.start()
    out = run.stdout.read()
    reader.join()
    code = run.wait()
    return out, err[0], 128 - code if code < 0 else code, int((time.monotonic() - began) * 1000)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        done = []
        for argv, cwd in rows:
            try:
                done.append(capture(argv, cwd))
            except OSError as e:
                done.append((b"", str(e).encode(), None, 0))
        out, err, code, took = zip(*done, strict=True) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(err, pa.binary()), pa.array(code, pa.int32()), pa.array(took, pa.int64())], names=["argv", "cwd", "stdout", "stderr", "exit_code", "duration_ms"])


def run_commands(commands: DataFrame) -> DataFrame:
    """``commands`` (argv, cwd) with both streams, exit code and duration.

    A command that can't be started has a null exit code and the reason on stderr: it
    is the caller's to pass through. A lost executor runs its commands again.
    """
    python_workers(commands.sparkSession)
    return commands.select("argv", "cwd").mapInArrow(_run, RUN)
