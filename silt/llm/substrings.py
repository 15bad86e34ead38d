"""Removal of long repeated word sequences by recompression.

A text's words are named by hashes and parsed in rounds. A run round names maximal
runs of one symbol; a pair round splits the alphabet by a hash into left and right
symbols and names each left symbol followed by a right one. A name depends on what it
stands for alone, so all executors give equal names without a shuffle, and equal
word sequences get the same interior symbols wherever they occur, up to a margin.

Three Spark rounds use the names:

1. Symbols of a middle level (the anchors) and all long symbols (``window`` words or
   more) are counted. Symbols that occur twice are joined back to their documents.
2. Words under a long symbol that occurs twice are repeated, with no further work. A
   window is a candidate if its anchor is repeated, or if it has no anchor that its
   words alone determine; only candidates are digested. Of a long symbol's
   occurrences, the host of least id alone hashes the windows inside it, for windows
   that also start outside any occurrence; copies are thus hashed once and not each.
3. Candidates whose hash occurs twice are joined back; their words are repeated.

Names only choose candidates, so two words of one hash cost time and nothing else. What
is removed is decided by letters: windows and long symbols are equal if 128 bits of
BLAKE2b over their words, joined by spaces, are.

The symbols that a window's words alone determine are tracked through the rounds; its
anchor is the few neighbours of least hash among them. So a window that occurs twice has an anchor
that occurs twice, or is a candidate outright: no repeat is missed, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, materialize
from .words import Words, as_utf8, hashes, mix, slices, split

WINDOW = 35
#: Pair rounds before the anchors are taken, and the words an anchor may have.
ANCHOR_ROUNDS = 4
ANCHOR_WORDS = 14
#: Neighbouring symbols named together as an anchor (fewer where a window has fewer).
ANCHOR_SYMBOLS = 3
#: Further pair rounds, and after how many of them long symbols are taken each time.
LONG_ROUNDS = 40
LONG_STEP = 4

_U = np.uint64


class Symbols(NamedTuple):
    """A level of the parse: each symbol's name, first word and text."""

    name: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    seen: np.ndarray  # taken at an earlier level


def _lengths(s: Symbols, n_words: int) -> np.ndarray:
    return np.diff(np.append(s.start, n_words))


def _run_round(s: Symbols) -> tuple[Symbols, np.ndarray]:
    """Name maximal runs; also each symbol's new index."""
    head = np.ones(len(s.name), bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(head)))
    name = np.where(size > 1, mix(s.name[at] * _U(0x9E3779B97F4A7C15) + size.astype(_U), 11), s.name[at])
    return Symbols(name, s.start[at], s.doc[at], s.seen[at] & (size == 1)), np.cumsum(head) - 1


def _pair_round(s: Symbols, salt: int, n_words: int, cap: int | None) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Name left-right pairs of at most ``cap`` words; also new indices and sides."""
    right = (mix(s.name, 101 + salt) & _U(1)).astype(bool)
    first = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1])
    if cap is not None:
        size = _lengths(s, n_words)
        first &= size[:-1] + size[1:] <= cap
    head = np.ones(len(s.name), bool)
    head[1:] = ~first
    name, seen = s.name.copy(), s.seen.copy()
    i = np.flatnonzero(first)
    name[i] = mix(s.name[i] * _U(0xC2B2AE3D27D4EB4F) + mix(s.name[i + 1], 13), 17)
    seen[i] = False
    return Symbols(name[head], s.start[head], s.doc[head], seen[head]), np.cumsum(head) - 1, right


class Parse(NamedTuple):
    anchor_name: np.ndarray
    anchor_doc: np.ndarray
    window: np.ndarray  # starts of the windows that have an anchor
    anchor: np.ndarray  # its index, for each of them
    bare: np.ndarray  # starts of the windows without
    long_name: np.ndarray
    long_check: np.ndarray
    long_start: np.ndarray
    long_end: np.ndarray


class Letters:
    """The words of some texts joined by single spaces, to be compared by their letters."""

    def __init__(self, w: Words):
        size = w.end - w.start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        at = np.repeat(w.start - self.start, size + 1) + np.arange(int(self.end[-1]) + 1 if len(size) else 0)
        joined = w.data[np.minimum(at, max(len(w.data) - 1, 0))]
        joined[self.end] = 0x20
        self.joined = joined.tobytes()

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of BLAKE2b in 128 bits of each stretch of words start..end."""
        digest, joined = blake2b, self.joined
        spans = zip(self.start[start].tolist(), self.end[end - 1].tolist(), strict=True)
        raw = b"".join([digest(joined[a:b], digest_size=16).digest() for a, b in spans])
        halves = np.frombuffer(raw, _U).reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy()


def starts_of_windows(w: Words, width: int) -> np.ndarray:
    """First words of all windows that lie in one text."""
    n = np.diff(w.first)
    ok = np.repeat(w.first[1:] - width, n) >= np.arange(len(w.start))
    return np.flatnonzero(ok)


def _least(order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The leftmost index of the least value of ``order`` within left..right, for each pair."""
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at, end = left[new], right[new]
    best, least = at.copy(), order[at]
    for d in range(1, int((end - at).max(initial=0)) + 1):
        i = np.minimum(at + d, end)
        less = order[i] < least
        best[less], least[less] = i[less], order[i][less]
    return best[np.cumsum(new) - 1]


def _anchors(name: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and first symbols of the anchors, and each window's anchor among them."""
    size = np.minimum(right - left + 1, ANCHOR_SYMBOLS)
    code = np.zeros(len(left), np.int64)
    joined, names = name, {}
    for k in range(1, ANCHOR_SYMBOLS + 1):
        if k > 1:
            joined = mix(joined[:-1] * _U(0xD6E8FEB86659FD93) + mix(name[k - 1 :], 53), 59)
        names[k], some = joined, size == k
        if some.any():
            code[some] = _least(mix(joined, 61), left[some], right[some] - k + 1) * (ANCHOR_SYMBOLS + 1) + k
    own, which = np.unique(code, return_inverse=True)
    at, k = np.divmod(own, ANCHOR_SYMBOLS + 1)
    out = np.zeros(len(own), _U)
    for x in names:
        out[k == x] = names[x][at[k == x]]
    return out, at, which


def parse(w: Words, h: np.ndarray, width: int = WINDOW) -> Parse:
    """Anchors of all windows, and long symbols, of some texts' words with hashes h.

    left and right bound the symbols of a window that its words alone determine: a run
    round leaves out the outermost runs, a pair round the outermost symbols that could
    pair with a neighbour outside.
    """
    n = len(h)
    s = Symbols(h, np.arange(n), w.doc, np.zeros(n, bool))
    p = starts_of_windows(w, width)
    left, right, bare = p, p + width - 1, []
    s, index = _run_round(s)
    left, right = index[left] + 1, index[right] - 1
    for k in range(ANCHOR_ROUNDS):
        gone = left > right
        bare.append(p[gone])
        p, left, right = p[~gone], left[~gone], right[~gone]
        s, index, side = _pair_round(s, k, n, ANCHOR_WORDS)
        left, right = left + side[left], right - ~side[right]
        gone = left > right
        bare.append(p[gone])
        p, left, right = p[~gone], index[left[~gone]], index[right[~gone]]
    anchor_name, at, anchor = _anchors(s.name, left, right)
    anchor_doc = s.doc[at]
    starts, ends = [], []
    for k in range(LONG_ROUNDS):
        before = len(s.name)
        s, _, _ = _pair_round(s, ANCHOR_ROUNDS + k, n, None)
        if k % LONG_STEP == LONG_STEP - 1:
            size = _lengths(s, n)
            i = np.flatnonzero((size >= width) & ~s.seen)
            s.seen[i] = True
            starts.append(s.start[i])
            ends.append(s.start[i] + size[i])
            if before == len(s.name) and (np.diff(s.doc) != 0).all():
                break
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    start, end = cat(starts), cat(ends)
    name, check = Letters(w).digests(start, end)
    return Parse(anchor_name, anchor_doc, p, anchor, cat(bare), name, check | _U(1), start, end)


def _symbols_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = as_utf8(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(texts):
                w = split(texts, a, b)
                if not len(w.start):
                    continue
                x = parse(w, hashes(w), width)
                name = np.concatenate((x.anchor_name, x.long_name)).view(np.int64)
                check = np.concatenate((np.zeros(len(x.anchor_name), _U), x.long_check)).view(np.int64)
                doc = np.concatenate((x.anchor_doc, w.doc[x.long_start]))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(check), pa.array(rid[a:b][doc])], names=["name", "check", "rid"])

    return run


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words under any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def _spans(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal true stretches, cut where a text begins."""
    edge = np.zeros(len(flag) + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], flag[:-1]))
    after = np.concatenate((flag[1:], [False]))
    return np.flatnonzero(flag & (~before | edge[:-1])), np.flatnonzero(flag & (~after | edge[1:])) + 1


def _among(name: np.ndarray, doc: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each name is in its text's list."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    own = mix(lists.flatten().to_numpy().view(_U) ^ mix(np.repeat(np.arange(len(lists)), sizes).astype(_U), 41), 43)
    return np.isin(mix(name ^ mix(doc.astype(_U), 41), 43), own)


_FOUND = "rid long, rid2 long, s int, e int, h1 long, h2 long"


def _candidates_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rid2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, known, elsewhere = as_utf8(batch.column(2)), batch.column(3), batch.column(4)
            for a, b in slices(texts):
                w = split(texts, a, b)
                n = len(w.start)
                if n < width:
                    continue
                h = hashes(w)
                x = parse(w, h, width)
                twice, lent = (_among(x.long_name ^ x.long_check, w.doc[x.long_start], k.slice(a, b - a)) for k in (known, elsewhere))
                covered = _covered(n, x.long_start[twice], x.long_end[twice])
                s, e = _spans(covered, w.first)
                if len(s):
                    doc = w.doc[s]
                    base = w.first[doc]
                    none = pa.nulls(len(s), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][doc]), pa.array(rid2[a:b][doc]), pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32)), none, none], names=["rid", "rid2", "s", "e", "h1", "h2"])
                again = _among(x.anchor_name, x.anchor_doc, known.slice(a, b - a))
                p = np.sort(np.concatenate((x.window[again[x.anchor]], x.bare)))
                p = p[~_covered(n, x.long_start[lent], x.long_end[lent] - width + 1)[p]]
                if len(p):
                    doc = w.doc[p]
                    h1, h2 = (x.view(np.int64) for x in Letters(w).digests(p, p + width))
                    at = (p - w.first[doc]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][doc]), pa.array(rid2[a:b][doc]), pa.array(at), pa.array(at + np.int32(width)), pa.array(h1), pa.array(h2)], names=["rid", "rid2", "s", "e", "h1", "h2"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = as_utf8(batch.column(1)).to_pylist(), batch.column(2)
        total, removed, kept = [], [], []
        edge = np.concatenate(([0], np.cumsum(np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
        flat = spans.flatten()
        s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
        for k, text in enumerate(texts):
            words = text.encode().split()
            total.append(len(words))
            a, b = edge[k], edge[k + 1]
            if b > a:
                drop = _covered(len(words), s[a:b], e[a:b])
                words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of ``docs``.

    Words are runs of other than ASCII white space; kept_text joins those kept by one
    space. A word goes if a window of ``window`` words over it also starts anywhere
    else, in this or another row. All windows are judged on the input. Null and empty
    texts have no words; texts shorter than a window lose none; rows with a null or
    repeated id are rows like any other, so a row that comes twice loses every word
    under a window; an empty table gives no rows; other columns are ignored.
    """
    fresh(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    if not 2 * ANCHOR_WORDS < window:
        raise ValueError("the window must be longer than two anchors")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("id", "text")).withColumn("rid2", F.xxhash64(F.lit(7), "text", "id"))

    symbols = materialize(rows.select("rid", "text").mapInArrow(_symbols_of(window), "name long, check long, rid long"), "substr-symbols")
    twice = symbols.groupBy("name", "check").agg(F.count("*").alias("n"), F.min("rid").alias("host")).where("n > 1")
    twice = materialize(twice.select("name", "check", "host"), "substr-twice")
    key = F.col("name").bitwiseXOR(F.col("check"))
    known = symbols.join(twice, ["name", "check"]).groupBy("rid")
    known = known.agg(F.collect_set(key).alias("known"), F.collect_set(F.when((F.col("host") != F.col("rid")) & (F.col("check") != 0), key)).alias("elsewhere"))
    known = materialize(known, "substr-known")
    discard(symbols, twice)

    found = rows.join(known, "rid", "left").select("rid", "rid2", "text", "known", "elsewhere").mapInArrow(_candidates_of(window), _FOUND)
    found = materialize(found, "substr-found")
    open_ = found.where("h1 is not null")
    again = materialize(open_.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "substr-again")
    hits = open_.join(again, ["h1", "h2"]).select("rid", "rid2", "s", "e").unionByName(found.where("h1 is null").select("rid", "rid2", "s", "e"))
    spans = materialize(hits.groupBy("rid", "rid2").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "substr-spans")
    discard(known, found, again)
    return rows.join(spans, ["rid", "rid2"], "left").select("id", "text", "spans").mapInArrow(_kept, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def oracle_sql(id_col: str = "doc_id", table: str = "documents", window: int = WINDOW) -> str:
    """The digest of ``remove_repeats`` in DuckDB SQL, by comparing all windows."""
    last = window - 1
    return f"""
WITH t AS (SELECT {id_col} AS id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table}),
p AS (SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
k AS (SELECT n, i, word, CASE WHEN count(*) OVER f = {window} THEN md5(string_agg(word, ' ') OVER f) END AS key
  FROM p WINDOW f AS (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)),
d AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
m AS (SELECT k.n, k.i, k.word, max((d.key IS NOT NULL)::INT) OVER (PARTITION BY k.n ORDER BY k.i ROWS BETWEEN {last} PRECEDING AND CURRENT ROW) AS gone
  FROM k LEFT JOIN d USING (key)),
g AS (SELECT n, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY n)
SELECT id AS {id_col}, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (n)"""
