"""Operators over texts, each against brute force on small inputs."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from silt.llm import decontaminate as D
from silt.llm import packing, queries, secrets, simhash, substrings, words

SCHEMA = "doc_id long, text string, lang string, rid long, id string"
ODD = [None, "", " \t\n\x0b\x0c\r", "é\u2003ü", "a", "\x00 \x1f", "日本 語", "A b  c\td\ne", "x " * 400]


def frame(spark, texts, schema=SCHEMA):
    """Texts with ids, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, "z") for i, t in texts], schema)


def split(text):
    return (text or "").encode().split()


def corpus(seed, n=160):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.3:
                parts += rng.choice(passages)
            elif kind < 0.4:
                parts += [rng.choice(pool)] * rng.randint(1, 80)
            elif kind < 0.5:
                parts += [rng.choice(pool), rng.choice(pool)] * rng.randint(1, 40)
            else:
                parts += [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out + rng.sample(out, 12) + ODD


def test_words_match_split():
    texts = ODD + corpus(1, 20)
    w = words.split(words.as_utf8(pa.array(texts)))
    got = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in split(t)]
    h = words.hashes(w)
    assert len(set(got)) == len(set(h.tolist())) and len({(x, y) for x, y in zip(got, h.tolist(), strict=True)}) == len(set(got))
    part = words.split(words.as_utf8(pa.array(texts)).slice(5), 2, 9)
    assert [part.data[a:b].tobytes() for a, b in zip(part.start, part.end, strict=True)] == [x for t in texts[7:14] for x in split(t)]


# -- substring dedup -------------------------------------------------------------------


def removed(texts, width=35):
    seen = Counter(tuple(w[k : k + width]) for w in map(split, texts) for k in range(len(w) - width + 1))
    for t in texts:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        yield len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(frame(spark, enumerate(texts))).collect()}
    want = list(removed(texts))
    assert [got[i] for i in range(len(texts))] == want
    assert sum(r for _, r, _ in want)


def test_substrings_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(None, long), (None, long), (1, "a b"), (1, None), (2, long + " tail")]
    got = sorted((r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 0), (2, 0), (60, 60), (60, 60), (61, 60)]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_colliding_words_are_told_apart(spark):
    """Two words of 1024 letters whose polynomial hashes agree in every base."""
    flip = {"a": "b", "b": "a"}
    one = "a"
    for _ in range(10):
        one += "".join(flip[c] for c in one)
    two = "".join(flip[c] for c in one)
    w = words.split(pa.array([f"{one} {two}"]))
    assert len(set(words.hashes(w).tolist())) == 1
    rest = [f"v{k}" for k in range(80)]
    texts = [" ".join([*rest[:17], x, *rest[17:34]]) for x in (one, two)] + [" ".join([*rest[:60], x]) for x in (one, two)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(frame(spark, enumerate(texts))).collect()}
    assert [got[i] for i in range(4)] == list(removed(texts)) and got[0][1] == got[1][1] == 0 and got[2][1] == 60


# -- simhash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(seed):
    rng = random.Random(seed)
    base = [[f"q{rng.randint(0, 900)}" for _ in range(rng.randint(20, 150))] for _ in range(8)]
    out = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 30)}"
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out + ODD


@pytest.mark.parametrize("max_bucket", [4096, 3])
def test_simhash(spark, max_bucket):
    texts = near(3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, enumerate(texts)), max_bucket=max_bucket).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(root)
        for i, f in enumerate(fps):
            root[i] = min(root[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= 4)
        if before == root:
            break
    assert [got[i]["component_id"] for i in range(len(fps))] == root
    assert len(set(root)) < len(set(fps))


def test_forest_connects_what_is_close():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(-(2**62), 2**62, 6)[rng.integers(0, 6, 300)] ^ (1 << rng.integers(0, 63, 300)) ^ (1 << rng.integers(0, 63, 300)))
    links = simhash._forest(fps, 4)
    assert all((a ^ b).bit_count() <= 4 or (np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).item().bit_count() <= 4 for a, b in links)
    assert len(links) == len(fps) - len({min(x) for x in components(fps, links)})


def components(nodes, links):
    sets = {int(n): {int(n)} for n in nodes}
    for a, b in links:
        if sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for x in sets[b]:
                sets[x] = sets[a]
    return sets.values()


def similar_groups(texts):
    """The components of 0.8 of five-word shingles, by comparing all; each as its least place."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        before = list(root)
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b))
        if root == before:
            return root
    return root


def near_and_far(seed):
    """Copies with a share of their words changed that puts them on either side of 0.8."""
    rng = random.Random(seed)
    out = [*ODD, "one two", "one two", "One Two", "one two three four five"]
    for _ in range(14):
        base = [f"q{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for k in rng.sample(range(len(w)), int(len(w) * rng.choice([0, 0.005, 0.01, 0.015, 0.06, 0.1]))):
                w[k] = f"z{rng.randint(0, 5000)}"
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize(("bucket", "few", "many"), [(4096, 16, 256), (4096, 2, 256), (4096, 2, 4), (5, 2, 4)])
def test_links_of_crowded_keys(monkeypatch, bucket, few, many):
    """All pairs, least forests, other forests and keys in parts connect the same groups, run in this process."""
    for name, value in (("MAX_BUCKET", bucket), ("FEW", few), ("MANY", many)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**64, (5, simhash.LANES), np.uint64, endpoint=False)
    fps = np.unique(centres[rng.integers(0, 5, 60)] ^ (np.uint64(1) << rng.integers(0, 64, (60, simhash.LANES)).astype(np.uint64)), axis=0)
    keys = np.sort(rng.integers(0, 3, len(fps)))
    rows = np.concatenate([fps[keys == k] for k in range(3)])
    columns = [pa.array(keys), *(pa.array(rows[:, n].copy().view(np.int64)) for n in range(simhash.LANES))]
    whole = pa.RecordBatch.from_arrays(columns, names=["key", *simhash._LANES])
    batches = [whole.slice(k, 7) for k in range(0, len(rows), 7)]
    want, got = {}, {}
    for name, linked in (("want", None), ("got", simhash._wide_links(iter(batches)))):
        root = {(k, *r): (k, *r) for k, r in zip(keys.tolist(), map(tuple, rows.tolist()), strict=True)}
        pairs = []
        if linked is None:
            pairs = [(a, b) for a in root for b in root if a[0] == b[0] and sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:], strict=True)) <= simhash.WIDE_DISTANCE]
        else:
            for batch in linked:
                ends = [c.to_numpy().view(np.uint64).tolist() for c in batch.columns]
                for row in zip(*ends, strict=True):
                    a, b = row[: simhash.LANES], row[simhash.LANES :]
                    assert 0 < sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= simhash.WIDE_DISTANCE
                    k = next(n[0] for n in root if n[1:] == a)
                    pairs.append(((k, *a), (k, *b)))
        for _ in range(len(root)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        (want if name == "want" else got).update(root)
    assert want == got and len(set(want.values())) < len(want)
    ends = [[c.to_numpy().view(np.uint64).tolist() for c in b.columns] for b in simhash._wide_links(iter(batches), mark=True)]
    marked = {row[: simhash.LANES] for b in ends for row in zip(*b, strict=True) if row[: simhash.LANES] == row[simhash.LANES :]}
    sizes = Counter(want.values())
    assert marked >= {n[1:] for n in want if sizes[want[n]] > few}


def test_keep_one(spark):
    texts = near_and_far(4)
    roots = similar_groups(texts)
    docs = frame(spark, [*enumerate(texts), (None, "a lonely text of its own kind"), (5, "another text under the id of five"), (5, "another text under the id of five")])
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted([*set(roots), 5])
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.keep_one(frame(spark, [])).count() == 0 and simhash.near_duplicates(frame(spark, [])).count() == 0
    clash = docs.select("doc_id", "text", *(F.lit("mine").alias(c) for c in ("_row", "_key", "row", "t1", "node", "f0", "id", "a.b")))
    assert {tuple(r[2:]) for r in simhash.keep_one(clash).collect()} == {("mine",) * 8}


@pytest.mark.parametrize(("words_of", "changed"), [(300, 5), (120, 2)])
def test_crowded_families(spark, words_of, changed):
    """Many different texts of one template, on either side of 0.8: no link is lost."""
    rng = random.Random(words_of)
    base = [f"w{rng.randrange(5000)}" for _ in range(words_of)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(changed):
            w[rng.randrange(words_of)] = f"z{rng.randrange(5000)}"
        texts.append(" ".join(w))
    roots = similar_groups(texts)
    assert 1 < len(set(roots)) < len(texts)
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, enumerate(texts))).collect()) == sorted(set(roots))


def test_links_of_a_large_family(spark, monkeypatch):
    """A family's candidates are a few for each member, whatever keys it meets under, and no link is lost."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(5000)}"
        texts.append(" ".join(w))
    counts, write = {}, simhash.materialize

    def counted(df, label):
        out = write(df, label)
        counts.setdefault(label, out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, enumerate(texts))).collect())
    assert kept == sorted(set(similar_groups(texts))) and len(kept) < len(texts)
    assert counts["simhash-crowded"] > 250 and counts["simhash-links"] <= 10 * len(texts)


def test_rarest_shingles_join():
    """Every alike pair shares one of its rarest shingles and passes the bounds, whatever ranks them."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(1, 60), False), rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)))) for _ in range(300)]
    sets += [base[:1], np.zeros(0, np.uint64), np.unique(base)]
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) > 0
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([x.tobytes() for x in sets])], names=["node", "set"])
    counts = np.zeros(simhash.RANKS, np.int64)
    for b in simhash._rank_counts(iter([batch.select(["set"])])):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    assert counts.sum() == sum(map(len, sets))
    for ranks in (counts, np.zeros_like(counts)):
        keys = pa.Table.from_batches(simhash._prefixes(iter([batch]), ranks))
        keys = keys.append_column("root", keys["node"]).sort_by([(c, "ascending") for c in ("key", "size", "node")])
        got = {p for b in simhash._sharing(None)(iter(keys.to_batches(max_chunksize=37))) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert len(want) > 20 and want <= got
        few = [b for b in simhash._sharing(2)(iter(keys.to_batches(max_chunksize=37)))]
        assert 0 < sum(len(b) for b in few) <= 2 * len(keys)


# -- packing ---------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = queries.tokenizer()
    slow = Tokenizer.from_file(files["tokenizer_path"])
    texts = [*ODD, "<|endoftext|> in a text", "naïve 😀 text\r\n" * 900, *corpus(3, 30)]
    want = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for length, options in [(2048, files), (64, {"tokenizer_path": files["tokenizer_path"]})]:
        rows = packing.pack(frame(spark, enumerate(texts)).repartition(5), length=length, **options).collect()
        sequences: dict[int, list] = {}
        for i, ids in want.items():
            own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            at = 0
            for r in own:
                piece = ids[at : at + r["length"]]
                assert (r["start"], r["doc_tokens"], len(piece)) == (at, len(ids), r["length"])
                raw = np.array(piece, "<u4").tobytes()
                assert bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw)
                at += r["length"]
            assert at == len(ids)
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        sizes = []
        for k in range(len(sequences)):
            at = 0
            for offset, n in sorted(sequences[k]):
                assert offset == at
                at += n
            sizes.append(at)
        assert all(s == length for s in sizes[:-1]) and 0 < sizes[-1] <= length
    assert packing.pack(frame(spark, []), **files).count() == 0


def test_packing_refuses_other_ranks(spark, tmp_path):
    files = queries.tokenizer()
    lines = open(files["ranks_path"], "rb").read().split(b"\n")
    a, b = lines[65].split(b" "), lines[66].split(b" ")
    lines[65], lines[66] = a[0] + b" " + b[1], b[0] + b" " + a[1]
    other = tmp_path / "ranks"
    other.write_bytes(b"\n".join(lines))
    encode = packing.encoder(files["tokenizer_path"], str(other), files["pattern"])
    with pytest.raises(ValueError, match="other ids"):
        encode(pa.array(["b c"]))


def test_fast_ids_are_the_tokenizers(spark):
    """What makes the two encoders equal on every ordinary text, part by part."""
    import base64
    import json

    from tokenizers import Tokenizer

    files = queries.tokenizer()
    slow, fast = Tokenizer.from_file(files["tokenizer_path"]), packing._ranks(files["ranks_path"], files["pattern"])
    model = json.load(open(files["tokenizer_path"]))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    assert [model["vocab"][a + b] for a, b in merges] == sorted(model["vocab"][a + b] for a, b in merges)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files["ranks_path"], "rb"))}
    assert sorted(ranks.values()) == sorted(model["vocab"].values())
    for token, i in model["vocab"].items():
        assert [x.id for x in slow.model.tokenize(token)] == [i]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        # a point beside a letter, a digit, a mark and white space: its class decides where words part
        texts = [f"a{c}b 1{c}2 !{c}? {c} {c}{c}  {c}" for c in points[k : k + 50_000]]
        assert [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)] == [fast.encode_ordinary(t) for t in texts]


def test_packing_of_very_long_texts(spark):
    """Texts of one class of characters, where the fast encoder would run out of stack."""
    from tokenizers import Tokenizer

    files = queries.tokenizer()
    slow = Tokenizer.from_file(files["tokenizer_path"])
    n = 1_000_000
    texts = [" " * 5 * n, "\n" * n, "a" * n, "ab1" * n, "\u3000" * n, " " * packing.STRETCH, "a" + " " * (packing.STRETCH + 1) + "b", None, "x", "日本" * n, "<>" * n]
    got = packing.stretched(words.as_utf8(pa.array(texts)))
    assert got.tolist() == [True, True, True, True, True, False, True, False, False, True, True]
    rows = packing.pack(frame(spark, enumerate(texts)).repartition(4), **files).collect()
    for i, t in enumerate(texts):
        own = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert b"".join(x for _, x in own) == np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


# -- decontamination -------------------------------------------------------------------


def least_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        cur = [i + 1]
        for j, d in enumerate(text):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_decontamination(spark):
    rng = random.Random(6)
    some = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n))
    items = [(k, some(rng.randint(20, 80))) for k in range(12)] + [(20, None), (21, " \n"), (22, "Ä Ö"), (None, some(40))]
    texts = [*ODD]
    for _ in range(150):
        x = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 9)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(["", "z", "b ", "\n"])
        texts.append(some(rng.randint(0, 90)) + rng.choice(["", " "]) + "".join(x).upper() + some(rng.randint(0, 90)))
    texts.append("ein ä\n ö hier")
    docs = frame(spark, enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pass_chars in (10**6, 150):
        got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, bench, pass_chars=pass_chars).collect()}
        want = {}
        for i, t in enumerate(texts):
            for k, item in items:
                flat = D.normalise(item)
                if flat and (d := least_distance(flat, D.normalise(t))) <= int(len(flat) * D.ERROR_RATE):
                    want[i, k] = d
        assert {k: r["distance"] for k, r in got.items()} == want and len(want) > 30
    by_id = dict(items)
    for (i, k), r in got.items():
        held = D.normalise(texts[i][r["start"] : r["end"]])
        assert least_distance(D.normalise(by_id[k]), held) == r["distance"]
    bad = {i for i, _ in want}
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == set(range(len(texts))) - bad
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(texts)
    assert D.contaminated(frame(spark, []), bench).count() == 0


def test_fold_keeps_length():
    assert D.fold("İSTANBUL ẞ É") == "İstanbul ß é" or len(D.fold("İSTANBUL ẞ É")) == len("İSTANBUL ẞ É")


# -- secrets ---------------------------------------------------------------------------

PATTERN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in PATTERN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(out)]


def secret_texts():
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [*ODD, 'é "password" : "abc', "secret:token : abcdefg", "TOKEN=" + hexes(40), "api_key=😀 apikey=--_--==", "AKIA" + "A" * 15 + " AKIAAKIA" + "Z9" * 9, hexes(23) + "g" + hexes(24), "ſecret=abcdefgh", "token = token = token = abc.def", hexes(30) * 3]
    for _ in range(200):
        parts = [rng.choice(["password", "Token", "apiKey", "=", ": ", '"', "'", "AKIA", hexes(rng.randint(1, 30)), "日", " ", "ABCDEF0123456789XYZ", "\n", "é"]) for _ in range(rng.randint(0, 30))]
        texts.append("".join(parts))
    return texts


def test_base_spans(spark):
    texts = secret_texts()
    got = {r["doc_id"]: r["s"] for r in secrets.scan(frame(spark, enumerate(texts))).select("doc_id", secrets.joined(secrets.KINDS[:3]).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(plain_spans(t)), t


def test_random_tokens(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["tion", "ing", "the", "and", "re", "er", "on", "an"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(9))
    texts = [" ".join(word() for _ in range(6)) for _ in range(300)]
    planted = {i: "".join(rng.choice(letters) for _ in range(40)) for i in range(0, 300, 10)}
    for i, key in planted.items():
        texts[i] += f" use {key} now"
    decoys = {5: "a" * 40 + "1", 15: "aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd22"}
    for i, t in decoys.items():
        texts[i] += " " + t
    got = {r["doc_id"]: r["random"] for r in secrets.scan(frame(spark, enumerate(texts))).collect()}
    found = {i for i, spans in got.items() if spans}
    assert len(found & set(planted)) >= 0.9 * len(planted) and not found & set(decoys)
    assert len(found - set(planted)) <= 2
    assert all(texts[i][s["s"] : s["e"]] == planted[i] for i in found & set(planted) for s in got[i])


def test_random_tokens_without_long_words(spark):
    """A key is found in a corpus with no ordinary long token; a plain identifier is not."""
    rng = random.Random(12)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    texts = [f"the key is {key} here", "no long words at all", "see some_identifier_of_the_configuration_file_that_was_written_there"]
    got = {r["doc_id"]: [(s["s"], s["e"]) for s in r["random"]] for r in secrets.scan(frame(spark, enumerate(texts))).collect()}
    assert got == {0: [(11, 75)], 1: [], 2: []}


def plain_battery(token):
    """The three tests, Fisher's combination and the ordinary p-value, by their textbook forms."""
    letters = next(a for p, a in secrets.ALPHABETS + [("", secrets.ANY)] if re.search(p, token))
    x, k, n = [letters.index(c) + 1 for c in token], len(letters), len(token)
    over = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(1, k + 1))
    uniform = over(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))))
    sides = [v > k / 2 for v in x]
    a, b = sum(sides), n - sum(sides)
    seen = 1 + sum(p != q for p, q in zip(sides, sides[1:], strict=False))
    mean, variance = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    runs = 2 * over(abs(seen - mean) / math.sqrt(variance)) if variance > 0 else 2.0 ** (1 - n)
    middle = (k + 1) / 2
    serial = 2 * over(abs(sum((p - middle) * (q - middle) for p, q in zip(x, x[1:], strict=False))) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    half = -math.log(uniform * runs * serial)
    scale = max(1, 26 / k)
    two, three = secrets.AGREE_2 * scale, secrets.AGREE_3 * scale**2
    agree, pairs = sum(x[i] == x[j] for i in range(n) for j in range(i)), n * (n - 1) / 2
    ordinary = over((pairs * two - agree) / math.sqrt(pairs * (two - two**2) + 6 * math.comb(n, 3) * (three - two**2)))
    return {"uniform": uniform, "runs": runs, "serial": serial, "random": math.exp(-half) * (1 + half + half**2 / 2), "ordinary": ordinary}


def test_battery_against_plain_tests(spark):
    rng = random.Random(13)
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    tokens = [some(a, rng.randint(20, 90)) for _, a in secrets.ALPHABETS for _ in range(6)] + [some(secrets.ANY, 64), "thequickbrownfoxjumpsoverthelazydog", "ab" * 15, "some_identifier_2019_of_something", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b")).select("t", "b.*").collect()
    for r in got:
        for name, p in plain_battery(r["t"]).items():
            assert math.isclose(r[name], p, rel_tol=1e-3, abs_tol=1e-6), (r["t"], name)


def test_no_span_in_ordinary_texts(spark):
    """10,000 texts of words, compounds, identifiers and paths, and one key among them."""
    rng = random.Random(14)
    syllables = ["tion", "ing", "the", "and", "re", "er", "on", "an", "ver", "keit", "schaft", "ment", "eau", "ción", "de", "con", "str", "al"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    shapes = [lambda: word(9), lambda: word(9).title(), lambda: "_".join(word(2) for _ in range(5)), lambda: "/" + "/".join(word(3) for _ in range(4)), lambda: "".join(word(2).title() for _ in range(5)), lambda: f"{word(7)}-{rng.randint(1900, 2030)}", lambda: word(8).upper()]
    rows = [(n, " ".join(rng.choice(shapes)() for _ in range(3))) for n in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.scan(docs).where("size(random) > 0").count() == 0
    key = "".join(rng.choice(secrets.UPPER + secrets.LOWER + secrets.DIGITS) for _ in range(64))
    more = docs.unionByName(spark.createDataFrame([(-1, f"use {key} now")], docs.schema))
    assert [(r["doc_id"], r["random"][0]["s"], r["random"][0]["e"]) for r in secrets.scan(more).where("size(random) > 0").collect()] == [(-1, 4, 68)]


def test_many_matches_in_one_text(spark):
    """Thousands of matches in a text: located and cut without a square of their number."""
    rng = random.Random(15)
    parts = [rng.choice([secrets_like(rng, 32), "é word", "AKIA" + "Q7" * 9, "token=abc", "token=abcdefg0123456789abcdef0123456789", "x" * 25]) for _ in range(20_000)]
    text = " ".join(parts)
    docs = frame(spark, [(1, text)])
    spans = secrets.scan(docs).select(secrets.joined(secrets.KINDS[:3]).alias("s"), "random").first()
    assert spans["s"] == ",".join(plain_spans(text))
    cover = sorted([(int(a), int(e)) for _, a, e in (x.split(":") for x in spans["s"].split(","))] + [(r["s"], r["e"]) for r in spans["random"]])
    out, at = [], 0
    for a, e in cover:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, e)
    assert secrets.redact(docs).first()["text"] == "".join(out) + text[at:]


def secrets_like(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_redact(spark):
    texts = secret_texts()
    docs = frame(spark, [*enumerate(texts), (None, "token=abcdefgh x")])
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, t in enumerate(texts):
        if not plain_spans(t) and "[secret]" not in (got[i] or ""):
            assert got[i] == t
        else:
            assert not plain_spans(got[i]) or "[secret]" in got[i]
    assert got[None] == "[secret] x" and secrets.redact(docs).columns == docs.columns
    clash = docs.select("doc_id", "text", *(F.lit("mine").alias(c) for c in ("_spans", "spans", "row", "tokens", "assign", "hex", "a.b")))
    assert {tuple(r[2:]) for r in secrets.redact(clash).collect()} == {("mine",) * 7}
    assert secrets.redact(frame(spark, [])).count() == 0 and secrets.scan(frame(spark, [])).count() == 0


def test_secret_scan_is_native(spark):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        secrets.redact(frame(spark, [(1, "x")])).select(F.length("text")).explain()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())
