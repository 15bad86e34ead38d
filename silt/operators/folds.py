"""The one stage that is a fold: repeated windows of blocks, found greedily.

Runs in Python workers, so nothing here needs a session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

MAX_WINDOW = 8
MIN_REPEATS = 3
LIVE_LEAST = MIN_REPEATS * 2


def fold_windows(keys: list[int]) -> tuple[set[int], dict[int, int]]:
    """Positions to drop and repeat counts by position, for one stream's live blocks.

    The longest windows are tried first, from left to right; where one stands three times
    or more in a row its copies are dropped and the search goes on behind them. Shorter
    windows see the same blocks again, dropped ones included.
    """
    n, dropped, counts = len(keys), set(), {}
    for w in range(min(MAX_WINDOW, n // MIN_REPEATS), 1, -1):
        # equal[i]: how many keys from i on equal the keys w further
        equal = [0] * (n + 1)
        for i in range(n - w - 1, -1, -1):
            equal[i] = equal[i + 1] + 1 if keys[i] == keys[i + w] else 0
        at = 0
        while at + MIN_REPEATS * w <= n:
            repeats = 1 + equal[at] // w
            if repeats >= MIN_REPEATS:
                dropped.update(range(at + w, at + w * repeats))
                counts.setdefault(at + w - 1, repeats)
                at += w * repeats
            else:
                at += 1
    return dropped, counts


def may_repeat(keys: np.ndarray) -> bool:
    """Whether some key equals those w and 2w further, as any repeated window needs."""
    return any(bool(((keys[: -2 * w] == keys[w:-w]) & (keys[w:-w] == keys[2 * w :])).any()) for w in range(2, min(MAX_WINDOW, len(keys) // MIN_REPEATS) + 1))


def fold_codes(streams: pd.Series) -> pd.Series:
    """For each stream's keys, a code for each: 0 stays, n is marked as n copies, -1 is
    dropped, -n is marked and then dropped. Streams without a hit have no codes."""

    def codes(keys: np.ndarray | None) -> np.ndarray | None:
        if keys is None or not may_repeat(keys):
            return None
        dropped, counts = fold_windows(keys.tolist())
        out = np.zeros(len(keys), np.int64)
        for i, n in counts.items():
            out[i] = n
        for i in dropped:
            out[i] = -max(1, out[i])
        return out

    return pd.Series([codes(k) for k in streams], dtype=object)
