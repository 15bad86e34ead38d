"""The default chain of stages, as DataFrame transforms in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.operators import blocks as B
from silt.operators import lines as L
from silt.operators import render as R
from silt.operators import stages as S
from silt.sources.streams import KEY, decode

#: Name and transform of each stage over blocks, in order.
STAGES: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
    ("progress", S.drop_progress),
    ("dedupe_blocks", S.collapse_adjacent),
    ("dedupe_windows", S.collapse_windows),
    ("classify", S.classify),
    ("failure_floor", S.failure_floor),
    ("context", S.failure_context),
]


def parse(streams: DataFrame) -> DataFrame:
    """Streams to blocks: lines are split, cleaned and flagged before the one shuffle."""
    extra = [c for c in streams.columns if c not in ("run_id", "stream", "raw")]
    return B.gather(B.split_repeats(B.assign_blocks(L.flag_lines(L.split_lines(streams)))), extra)


def run(streams: DataFrame, context_blocks: int = S.CONTEXT, stages: list[str] | None = None) -> DataFrame:
    """Marked blocks of every stream: (run_id, stream, block, lines, n_lines, class, keep, reason)."""
    blocks = parse(streams)
    for name, stage in STAGES:
        if stages is None or name in stages or name in ("progress", "classify"):
            blocks = stage(blocks, context_blocks) if name == "context" else stage(blocks)
    return blocks


def filter_view(streams: DataFrame, level: int = R.DETAIL, context_blocks: int = S.CONTEXT) -> DataFrame:
    """A view of every stream at a level; level 3 is the streams themselves."""
    return R.raw(streams) if level == R.RAW else R.render(run(streams, context_blocks), streams, level)


def filter_bytes(streams: DataFrame, level: int = R.DETAIL, context_blocks: int = S.CONTEXT) -> DataFrame:
    """Views of binary streams: (run_id, stream, body, in_lines, out_lines), body as bytes.

    A stream that is not UTF-8 is shown as it is, with its line ends as its lines.
    """
    known = decode(streams)
    other = known.where(~F.col("is_text")).select(*KEY, F.col("raw").alias("body"), _line_ends(F.col("raw")).alias("in_lines"), _line_ends(F.col("raw")).alias("out_lines"))
    text = known.where("is_text").select(*KEY, F.col("text").alias("raw"), "exit_code")
    blocks = run(text, context_blocks)
    if level == R.RAW:
        views = text.select(*KEY, F.col("raw").alias("body")).join(R.accounting(blocks).select(*KEY, "lines", "kept_lines"), KEY, "left")
    else:
        views = R.counted(blocks, text.select(*KEY), level)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    shown = views.select(*KEY, F.encode("body", "UTF-8").alias("body"), zero("lines").alias("in_lines"), zero("kept_lines").alias("out_lines"))
    return shown.unionByName(other)


def _line_ends(raw):
    """The number of line ends in bytes."""
    text = F.decode(raw, "ISO-8859-1")
    return (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long")
