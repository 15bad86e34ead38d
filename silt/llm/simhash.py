"""SimHash near-duplicate detection by pigeonhole blocks.

Fingerprints of 64 bits that differ in at most ``distance`` bits agree on at least
``blocks - distance`` of ``blocks`` blocks, so every close pair meets under one of
C(blocks, distance) keys made of the agreeing blocks. Identical fingerprints are
collapsed first; each key's fingerprints are read in one sorted stream, verified by
Hamming distance and reduced to a spanning forest, so a group of n close fingerprints
yields n - 1 links and not n squared. A key with more than ``max_bucket`` distinct
fingerprints is not compared at all: its fingerprints go to an exact linear path,
where each one names every point within half the distance and two that name the same
point are linked (they are within the distance, and any two that are share one).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, materialize
from .components import components
from .words import as_utf8, hashes, mix, slices, split, window_hashes

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
MAX_BUCKET = 4096

_FLIP = 1 << 63


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 where it has no words.

    A-Z are lower-cased, words are runs of other than ASCII white space. A bit is set
    if it is set in over half of the shingles' XXH64, repeats included.
    """
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    digest = xxhash.xxh64_digest
    n = len(words) - shingle + 1
    heads, tails = at[:n].tolist(), (at[shingle : shingle + n] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        rows = b"".join([digest(joined[a:b], seed) for a, b in zip(heads[k : k + (1 << 16)], tails[k : k + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(rows, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""
    fresh(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1)).to_pylist()
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One long for each choice of agreeing blocks: the choice's number and a hash of its bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(masks, blocks - distance)):
        mask = sum(chosen)
        mask -= (1 << 64) if mask >= _FLIP else 0
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; numpy counts the bits of a signed value's absolute value, so as unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``distance`` among distinct values."""
    left, found = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _differ(left, x) <= distance
            if near.any():
                todo.extend(left[near])
                found.extend((int(x), int(y)) for y in left[near])
                left = left[~near]
    return found


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, values, hot) of whole runs of a sorted stream; a run over ``limit`` comes in parts, marked hot."""
    keys, vals, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        vals = np.concatenate((vals, batch.column(1).to_numpy()))
        if not len(keys):
            continue
        if hot is not None and keys[0] == hot:
            n = int(np.searchsorted(keys != hot, True)) if (keys != hot).any() else len(keys)
            yield keys[:n], vals[:n], True
            keys, vals = keys[n:], vals[n:]
            if not len(keys):
                continue
        hot = None
        tail = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        if tail:
            yield keys[:tail], vals[:tail], False
            keys, vals = keys[tail:], vals[tail:]
        if len(keys) > limit:
            hot = keys[0]
            yield keys, vals, True
            keys, vals = keys[:0], vals[:0]
    if len(keys):
        yield keys, vals, False


def _bucket_links(distance: int, max_bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, vals, hot in _runs(batches, max_bucket):
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(vals), pa.nulls(len(vals), pa.int64())], names=["a", "b"])
                continue
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            close = two[_differ(vals[two], vals[two + 1]) <= distance]
            a, b = [vals[close]], [vals[close + 1]]
            for s, n in zip(edge[:-1][size > 2], size[size > 2], strict=True):
                if n > max_bucket:
                    a.append(vals[s : s + n])
                    b.append(np.full(n, np.iinfo(np.int64).min))
                elif links := _forest(vals[s : s + n], distance):
                    x = np.array(links, np.int64)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                marked = pa.array(b, mask=b == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(a), marked], names=["a", "b"])

    return run


def _ball(radius: int) -> np.ndarray:
    one = [1 << i for i in range(64)]
    masks = [0] + [sum(c) for r in range(1, radius + 1) for c in combinations(one, r)]
    return np.array(masks, np.uint64).view(np.int64)


def _hot_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of over-full keys, linear in their number."""
    radius = distance // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _ball(radius)
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), 64):
                some = fps[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ masks).ravel()), pa.array(np.repeat(some, len(masks)))], names=["key", "fp"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = None
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            if key is not None:
                keys, fps = np.concatenate(([key], keys)), np.concatenate(([fp], fps))
            at = np.flatnonzero((keys[1:] == keys[:-1]) & (fps[1:] != fps[:-1]))
            key, fp = keys[-1], fps[-1]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[at + 1])], names=["a", "b"])

    met = hot.mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(chain, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints connected within ``distance``.

    ``fps`` has one long column fp of distinct values. Every link is within the
    distance; of a connected group only enough links to connect it are given.
    """
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even and below the number of blocks")
    keyed = fps.select(_block_keys(F.col("fp"), blocks, distance).alias("key"), "fp")
    met = materialize(
        keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(distance, max_bucket), "a long, b long"),
        "simhash-links",
    )
    hot = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return met.where("b is not null").unionByName(_hot_links(hot, distance))


def _rooted(own: DataFrame, distance: int, blocks: int, max_bucket: int) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint: its least id and its component."""
    fps = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    roots = components(links(fps.select("fp"), distance, blocks, max_bucket))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    out = materialize(rooted, "simhash-rooted")
    discard(fps, roots)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link like any other; rows with a
    null id are kept and never name a component; an empty table gives no rows; other
    columns are ignored. Repeated rows are returned as often as they come.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-docs")
    rooted = _rooted(own, distance, blocks, max_bucket)
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    classes = materialize(rooted.join(named, "root").select("fp", "component_id"), "simhash-classes")
    discard(rooted, named)
    return own.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of the wide fingerprints, for a similarity of 0.8 of five-word shingles: lanes of 64
#: bits, blocks of a lane, blocks that make a key, and bits of all lanes in which two may differ.
WIDE_SHINGLE = 5
LANES = 2
WIDE_BLOCKS, WIDE_AGREE = 10, 3
WIDE_DISTANCE = 26
#: The share of all their shingles that linked texts have in common, at least.
SIMILARITY = 0.8
#: Fingerprints of one group of which every close pair is verified; those of one key of which trees are least.
FEW, MANY = 16, 256
#: Links between crowded members that are verified before their shingles are joined, for each.
NEAREST = 8
#: Counters of the table that ranks shingles by how common they are; it settles an order only.
RANKS = 1 << 20
_CELLS = np.uint64(RANKS)


def wide_fingerprints(texts: pa.Array, a: int, b: int, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """LANES x 64 bits of each of texts a..b, rows x LANES; a bit is set if over half of the
    shingles' hashes have it. Texts of fewer words are one shingle; without words, zero."""
    w = split(texts, a, b, lower=True)
    h, n = hashes(w), np.diff(w.first)
    counts, out = np.zeros((b - a, 64 * LANES), np.int64), np.zeros((b - a, LANES), np.uint64)
    starts = np.flatnonzero(np.repeat(w.first[1:] - shingle, n) >= np.arange(len(h)))
    windows = [window_hashes(h, shingle, lane + 1) for lane in range(LANES)]
    for k in range(0, len(starts), 1 << 15):
        at = starts[k : k + (1 << 15)]
        bits = np.unpackbits(np.stack([x[at] for x in windows], axis=1).view(np.uint8).reshape(len(at), -1), axis=1)
        doc = w.doc[at]
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        counts[doc[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    out[:] = np.packbits(counts * 2 > np.maximum(n - shingle + 1, 1)[:, None], axis=1).view(np.uint64)
    for size in range(1, shingle):
        few = np.flatnonzero(n == size)
        if len(few):
            out[few] = np.stack([window_hashes(h, size, lane + 1)[w.first[few]] for lane in range(LANES)], axis=1)
    return out


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, lanes) for every choice of blocks of every lane."""
    cuts = [64 * i // WIDE_BLOCKS for i in range(WIDE_BLOCKS + 1)]
    masks = np.array([sum(((1 << (y - x)) - 1) << x for x, y in chosen) for chosen in combinations(list(zip(cuts, cuts[1:], strict=False)), WIDE_AGREE)], np.uint64)
    for batch in batches:
        fps = np.stack([c.to_numpy() for c in batch.columns], axis=1).view(np.uint64)
        for k in range(0, len(fps), 64):
            some = fps[k : k + 64]
            keys = [mix((some[:, lane, None] & masks) + np.arange(len(masks), dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 67 + lane) for lane in range(LANES)]
            row = np.tile(np.repeat(np.arange(len(some)), len(masks)), LANES)
            flat = np.concatenate([x.ravel() for x in keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(pa.array(some[row, lane].view(np.int64)) for lane in range(LANES))], names=["key", *_LANES])


_LANES = [f"f{n}" for n in range(LANES)]


def _wide_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def _wide_trees(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of distinct fingerprints, those with none within the distance, and a tree of each
    connected group: its members, and what each was reached from (the first: itself).

    Of MANY or fewer a least tree, which reaches each member from what it is closest to.
    """
    n = len(fps)
    if n <= MANY:
        apart = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2).astype(np.int64)
        some = (apart <= WIDE_DISTANCE).sum(axis=1) > 1
        lone, met = np.flatnonzero(~some), np.flatnonzero(some)
        apart = apart[np.ix_(met, met)]
        near, by, out = np.full(len(met), 1 << 20), np.arange(len(met)), np.zeros(len(met), bool)
        order, heads = [], []
        for place in range(len(met)):
            x = int(np.where(out, 1 << 21, near).argmin())
            if near[x] > WIDE_DISTANCE:
                heads.append(place)
                by[x] = x
            order.append(x)
            out[x] = True
            closer = ~out & (apart[x] < near)
            near[closer], by[closer] = apart[x][closer], x
        parts = np.split(np.array(order, np.int64), heads[1:]) if heads else []
        return lone, [(met[t], met[by[t]]) for t in parts]
    left, lone, trees = np.arange(n), [], []
    while len(left):
        at, by, todo, left = [left[:1]], [left[:1]], [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _wide_differ(fps[left], fps[x][None, :]) <= WIDE_DISTANCE
            if near.any():
                found = left[near]
                todo.extend(found)
                at.append(found)
                by.append(np.full(len(found), x))
                left = left[~near]
        if len(at) > 1:
            trees.append((np.concatenate(at), np.concatenate(by)))
        else:
            lone.append(at[0][0])
    return np.array(lone, np.int64), trees


def _wide_forest(fps: np.ndarray, crowd: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Links among distinct fingerprints, whether their group is over ``crowd``, one of each
    connected group, and the members of groups of over ``crowd``.

    Of a group of FEW every pair within the distance, of a larger one its tree.
    """
    lone, trees = _wide_trees(fps)
    ones, others, within, crowded = [], [], [], []
    for at, by in trees:
        own = fps[at]
        if len(at) <= FEW:
            i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(axis=2) <= WIDE_DISTANCE, 1))
            ones.append(own[i])
            others.append(own[j])
        else:
            ones.append(fps[by[1:]])
            others.append(own[1:])
        within.append(np.full(len(ones[-1]), len(at) > crowd))
        if len(at) > crowd:
            crowded.append(own)
    return ones, others, within, fps[np.concatenate((lone, [at[0] for at, _ in trees])).astype(np.int64)], crowded


def _wide_links(batches: Iterator[pa.RecordBatch], mark: bool = False) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints of one key, from a sorted stream.

    A key's rows are handled in parts of at most MAX_BUCKET; from part to part one of each
    group found is carried, so a group of copies of any size leaves one row. With ``mark``
    the members of groups of over FEW, and of all groups of keys in parts, come as links to themselves.
    """
    for batch in _told_links(batches, mark):
        yield batch.select(batch.schema.names[:-1])


def _told_links(batches: Iterator[pa.RecordBatch], mark: bool = True) -> Iterator[pa.RecordBatch]:
    """Those links, and of each whether its group's members were marked."""
    now, held = None, np.zeros((0, LANES), np.uint64)
    ones, others, within = [], [], []

    def link(fps: np.ndarray, crowd: int) -> np.ndarray:
        if len(fps) < 2:
            return fps
        x, y, told, first, crowded = _wide_forest(fps, crowd)
        ones.extend(x + crowded if mark else x)
        others.extend(y + crowded if mark else y)
        within.extend(told + [np.ones(len(c), bool) for c in crowded] if mark else told)
        return first

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
        for a, b in zip(edge, edge[1:], strict=False):
            if keys[a] != now:
                if len(held) > 1:
                    link(held, FEW)
                now, held = keys[a], fps[a:b]
                if b - a <= MAX_BUCKET:
                    continue
                held = held[:0]
            for k in range(a, b, MAX_BUCKET):
                held = link(np.concatenate((held, fps[k : min(b, k + MAX_BUCKET)])), 1)
        if sum(map(len, ones)):
            yield _link_rows(ones, others, within)
            ones.clear()
            others.clear()
            within.clear()
    link(held, FEW)
    if sum(map(len, ones)):
        yield _link_rows(ones, others, within)


def _link_rows(ones: list[np.ndarray], others: list[np.ndarray], within: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(ones).view(np.int64), np.concatenate(others).view(np.int64)
    columns = [pa.array(np.ascontiguousarray(x[:, lane])) for x in (a, b) for lane in range(LANES)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(within))], names=[*_ENDS, "crowded"])


_ENDS = [f"{x}{lane}" for x in "ab" for lane in range(LANES)]


def _closest(linked: DataFrame) -> DataFrame:
    """All links, but of those between two crowded members the NEAREST of each fingerprint.

    A large group is parted otherwise under every key, which makes up to 240 trees and many
    small groups of its members. They are joined by their rarest shingles whatever is
    linked here, so no link between two of them is needed; the closest, which are the
    likeliest to hold, save that join most of its pairs.
    """
    lanes = {x: [f"{x}{n}" for n in range(LANES)] for x in "ab"}
    apart = sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(lanes["a"], lanes["b"], strict=True))
    told = linked.withColumn("apart", apart).withColumn("own", F.col("apart") == 0)
    marked = {x: F.max("own").over(Window.partitionBy(*lanes[x])) for x in "ab"}
    loose = told.where(~F.col("crowded") | F.col("own")).withColumn("in_a", marked["a"]).withColumn("in_b", marked["b"])
    loose = loose.withColumn("spare", F.col("in_a") & F.col("in_b") & ~F.col("own")).drop("in_a", "in_b")
    both = loose.unionByName(told.where(F.col("crowded") & ~F.col("own")).withColumn("spare", F.lit(True)))
    place = F.row_number().over(Window.partitionBy(*lanes["b"], "spare").orderBy("apart", *lanes["a"]))
    return both.withColumn("place", place).where(~F.col("spare") | (F.col("place") <= NEAREST)).select(*_ENDS)


def shingle_sets(texts: pa.Array, a: int, b: int, shingle: int = WIDE_SHINGLE) -> list[bytes]:
    """The sorted distinct 64-bit shingle hashes of each of texts a..b."""
    w = split(texts, a, b, lower=True)
    h, n = hashes(w), np.diff(w.first)
    whole = window_hashes(h, shingle, 1)
    out = []
    for at, size in zip(w.first.tolist(), n.tolist(), strict=False):
        own = whole[at : at + size - shingle + 1] if size >= shingle else window_hashes(h[at : at + size], size, 1) if size else h[:0]
        out.append(np.unique(own).tobytes())
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of sets that share SIMILARITY of their members."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _least_size(size: np.ndarray) -> np.ndarray:
    """The members that a set alike to one of this size has at least, all of them shared."""
    return np.ceil(SIMILARITY * size - 1e-6).astype(np.int64)


def _rank_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): the shingles of a partition's sets, counted by RANKS cells."""
    counts = np.zeros(RANKS, np.int64)
    for batch in batches:
        members = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        counts += np.bincount((members % _CELLS).astype(np.int64), minlength=RANKS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, size, place, node): the rarest shingles of each set, so many that sets alike share one."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        n = np.where(size > 0, size - _least_size(size) + 1, 0)
        rare = [x[np.lexsort((x, counts[(x % _CELLS).astype(np.int64)]))[:k]] for x, k in zip(sets, n.tolist(), strict=True)]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.concatenate(rare).view(np.int64) if rare else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(size, n)), pa.array(place), pa.array(np.repeat(batch.column(0).to_numpy(), n))], names=["key", "size", "place", "node"])


def _sharing(partners: int | None):
    """Pairs of different groups that share a key and could be alike, of a stream sorted by key and size.

    By the sizes, and by how much can follow the first shared shingle. Of each row the
    ``partners`` closest in size, or all. Rows of a key too small for what follows are let go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            k = 0
            while k < rows.shape[1]:
                new = rows[:, k : k + max(1, min(512, (1 << 21) // (held.shape[1] + 512)))]
                k += new.shape[1]
                old = np.concatenate((held, new), axis=1)
                before = np.arange(old.shape[1])[None, :] < held.shape[1] + np.arange(new.shape[1])[:, None]
                i, j = np.nonzero(before & (old[0] == new[0][:, None]) & (old[4] != new[4][:, None]))
                n, m = new[1][i], old[1][j]
                follow = np.minimum(n - new[2][i], m - old[2][j])
                good = (m >= _least_size(n)) & (follow >= SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-6)
                i, j = i[good], j[good]
                if partners is not None:
                    close = np.searchsorted(i, i, "right") - np.arange(len(i)) <= partners
                    i, j = i[close], j[close]
                if len(i):
                    x, y = new[3][i], old[3][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                held = old[:, (old[0] == new[0, -1]) & (old[1] >= _least_size(new[1, -1]))]

    return run


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of nodes whose sets are alike."""
    sided = pairs.join(known.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return sided.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def _link_crowded(crowded: DataFrame, known: DataFrame, tested: DataFrame, alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, roots) once every alike pair of crowded nodes is linked, by whatever way.

    A group's tree proves what it connects only where all its links hold. So crowded nodes
    are joined by shingles too: sets that share SIMILARITY share one of their rarest, in
    whatever order that is the same for all. Groups that hold already are not
    compared again; the closest go first, as each link found saves others.
    """
    spark = known.sparkSession
    sets = materialize(known.join(crowded, "node", "left_semi"), "simhash-crowd-sets")
    counts = np.zeros(RANKS, np.int64)
    cells = sets.select("set").mapInArrow(_rank_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = spark.sparkContext.broadcast(counts)
    keys = materialize(sets.select("node", "set").mapInArrow(lambda batches: _prefixes(batches, table.value), "key long, size long, place long, node long"), "simhash-crowd-keys")
    roots = components(alike)
    for partners in (FEW, None):
        own = keys.join(roots, "node", "left").select("key", "size", "place", "node", F.coalesce("root", "node").alias("root"))
        met = own.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(_sharing(partners), "a long, b long").distinct()
        new = materialize(met.join(tested, ["a", "b"], "left_anti"), "simhash-crowd-pairs")
        more = materialize(alike.unionByName(_verified(new, known)), "simhash-alike")
        discard(alike, roots)
        alike, tested = more, tested.unionByName(new)
        roots = components(alike)
    discard(sets, keys)
    return alike, roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of least id, null ids last.

    Near duplicates share SIMILARITY or more of their five-word shingles. Candidates are
    fingerprints of 128 bits that differ in at most WIDE_DISTANCE, met under any three of ten equal blocks
    of either half; each is verified by the two texts' shingles. Members of groups too crowded to verify
    every pair are joined by their rarest shingles, which misses none; only their closest are verified before. Texts without words are copies of each other. Of rows with equal id
    and text one stays; an empty table gives no rows; other columns may have any names.
    Only keys and fingerprints are shuffled; texts are not, but those of repeated ids.
    """
    fresh(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    name = lambda n: F.col("`" + n.replace("`", "``") + "`")
    tags = [F.xxhash64(name(id_col), name(text_col)), F.xxhash64(F.lit(9), name(text_col), name(id_col))]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(3))
            found = [wide_fingerprints(texts, a, b) for a, b in slices(texts)]
            fps = np.concatenate(found).view(np.int64) if found else np.zeros((0, LANES), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(fps[:, lane])) for lane in range(LANES))], names=["id", "t1", "t2", *_LANES])

    lanes = ", ".join(f"{x} long" for x in _LANES)
    own = docs.select(name(id_col).alias("id"), tags[0].alias("t1"), tags[1].alias("t2"), name(text_col).alias("text"))
    own = materialize(own.mapInArrow(run, f"id {kind}, t1 long, t2 long, {lanes}"), "simhash-docs")
    least = F.min(F.struct(F.col("id").isNull(), "id", "t1", "t2")).alias("least")
    fps = own.groupBy(*_LANES).agg(least)
    fps = materialize(fps.withColumn("node", F.monotonically_increasing_id()), "simhash-fps")
    keyed = fps.select(*_LANES).mapInArrow(_wide_keys, f"key long, {lanes}").repartition("key").sortWithinPartitions("key", *_LANES)
    linked = materialize(keyed.mapInArrow(_told_links, ", ".join(f"{x} long" for x in _ENDS) + ", crowded boolean").groupBy(*_ENDS).agg(F.max("crowded").alias("crowded")), "simhash-linked")
    met = materialize(_closest(linked), "simhash-links")
    discard(linked)
    ends = lambda x: fps.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}{lane}") for lane, c in enumerate(_LANES)))
    paired = met.join(ends("a"), [f"a{n}" for n in range(LANES)]).join(ends("b"), [f"b{n}" for n in range(LANES)]).select("a", "b")
    pairs = materialize(paired.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    crowded = materialize(pairs.where("a = b").select(F.col("a").alias("node")), "simhash-crowded")
    paired = pairs.where("a <> b")
    needed = paired.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct().join(fps, "node").select("node", "least.t1", "least.t2")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1))
            found = [x for a, b in slices(texts) for x in shingle_sets(texts, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "set"])

    texts = docs.select(*(t.alias(f"t{n}") for n, t in enumerate(tags, 1)), name(text_col).alias("text")).join(needed, ["t1", "t2"]).select("node", "text")
    known = materialize(texts.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "simhash-sets")
    alike = materialize(_verified(paired, known), "simhash-alike")
    alike, roots = (alike, components(alike)) if crowded.isEmpty() else _link_crowded(crowded, known, paired, alike)
    discard(pairs, crowded, known, alike)
    rooted = fps.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    chosen = rooted.select("least.id", "least.t1", "least.t2")
    times = own.groupBy("id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1")
    chosen = chosen.join(times, (chosen["id"].eqNullSafe(times["id"])) & (chosen["t1"] == times["t1"]) & (chosen["t2"] == times["t2"]), "left").select(chosen["t1"], chosen["t2"], F.coalesce("n", F.lit(1)).alias("n"))
    kept = materialize(chosen, "simhash-kept")
    discard(own, fps, met, roots)
    rows = docs.select(F.struct(*(name(c).alias(c) for c in docs.columns)).alias("row"), tags[0].alias("t1"), tags[1].alias("t2"))
    single = rows.join(kept.where("n = 1"), ["t1", "t2"], "left_semi")
    repeated = rows.join(kept.where("n > 1"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    return single.unionByName(repeated).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
