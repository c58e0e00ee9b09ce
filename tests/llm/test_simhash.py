import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from provlake.llm import simhash
from provlake.llm.common import utf8_parts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, radius=4):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def corpus():
    rng = np.random.RandomState(3)
    vocab = np.array(["Straße", "word", "ÀB", "x", "日本", "I", "ok", "Zed"] + [f"w{i}" for i in range(300)])
    base = rng.choice(vocab, 400)
    docs = [(1, None), (2, ""), (3, " \t\x0b\n"), (4, "One two"), (5, "one\ttwo "), (None, "one two"), (6, "a b c d"), (7, "A b c\u0085d e"), (8, "z" * 70_000), (9, "w " * 300)]
    for i in range(50):
        t = base.copy()
        t[rng.randint(0, 400, i // 8)] = rng.choice(vocab, i // 8)
        docs.append((100 + i, " ".join(t)))
    docs += [(200 + i, " ".join(rng.choice(vocab, rng.randint(1, 60)))) for i in range(60)]
    return docs + [(300, docs[15][1]), (100, docs[10][1]), (100, docs[10][1])]


def test_against_brute_force(spark):
    docs = corpus()
    prints = [brute_print(t) for _, t in docs]
    roots = components_of(prints)
    least = {r: min((d for (d, _), x in zip(docs, roots) if x == r and d is not None), default=None) for r in roots}
    want = sorted([(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(docs, prints, roots)], key=str)
    df = spark.createDataFrame([(d, t, 1, b"s", "c") for d, t in docs], "doc_id long, text string, fp int, least binary, root string")
    got = simhash.classes(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_no_rows(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_a_null_id(spark):
    assert [tuple(r) for r in simhash.classes(spark.createDataFrame([(None, "")], "doc_id long, text string")).collect()] == [(None, "0" * 16, None)]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    raw, offsets = utf8_parts(pa.array([text, "", text + " end", "a"]))
    want = [brute_print(t) for t in (text, "", text + " end", "a")]
    assert simhash.fingerprints(raw, offsets).tolist() == want
    monkeypatch.setattr(simhash, "SHINGLES", 700)
    assert simhash.fingerprints(raw, offsets).tolist() == want


@pytest.mark.parametrize("small, tile", [(256, 32768), (16, 64), (7, 100)])
def test_tiles_lose_no_link(spark, monkeypatch, small, tile):
    rng = np.random.RandomState(9)
    seeds = rng.randint(0, 1 << 62, 40).astype(np.uint64)
    fp = [int(x) for x in seeds]
    for s in seeds:  # chains whose ends are further apart than the radius, some over quarters' borders
        x = int(s)
        for _ in range(rng.randint(1, 20)):
            for b in rng.choice(64, rng.randint(3, 7), replace=False):
                x ^= 1 << int(b)
            fp.append(x)
    fp = list(dict.fromkeys([*fp, 0, (1 << 64) - 1, 1 << 63]))
    for name, value in (("SMALL", small), ("MOST_TILE", tile), ("LEAST_TILE", tile)):
        monkeypatch.setattr(simhash, name, value)
    roots = components_of(fp)
    found = simhash.links(spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fp], "fp long"))
    number = {int(np.array(x, np.uint64).view(np.int64)): i for i, x in enumerate(fp)}
    up = list(range(len(fp)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    rows = found.collect()
    for r in rows:
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4
        up[find(number[r["a"]])] = find(number[r["b"]])
    mine = [find(i) for i in range(len(fp))]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_copies_give_a_forest():
    rng = np.random.RandomState(1)
    fp = np.unique(np.array([0xF0F0F0F0F0F0F0F0 ^ (1 << int(rng.randint(64))) ^ (1 << int(rng.randint(64))) for _ in range(3000)], np.uint64))
    a, b = simhash.compare(simhash.ordered(fp), None)
    assert len(a) == len(fp) - 1 and (np.bitwise_count(a ^ b) <= 4).all()
