import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provlake.llm import suffix_dedup as S
from provlake.llm.lyndon import suffix_arrays


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=8))
def test_suffix_arrays(lanes):
    lanes = [[*x, 0] for x in lanes]
    starts = np.cumsum([0, *map(len, lanes)])
    got = suffix_arrays(np.array(sum(lanes, [])), starts)
    for x, a, b in zip(lanes, starts[:-1], starts[1:], strict=True):
        assert (got[a:b] - a).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute(docs):
    """(n_bytes, n_removed, n_spans, sha) by doc; null ids are smallest."""
    seen = {}
    for doc, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            k, d = b[i : i + 50], -1 if doc is None else doc
            seen[k] = min(seen.get(k, d), d)
    out = []
    for doc, text in docs:
        b, d = (text or "").encode(), -1 if doc is None else doc
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.RandomState(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.randint(2, 7)))
    line = " ".join(word() for _ in range(18))
    docs = [(None, line), (1, None), (2, ""), (3, " "), (4, line + " x"), (5, line), (5, line), (6, "aaaa " * 60), (7, "aaaa " * 40 + "b"), (8, "ab" * 200)]
    for i in range(10, 60):
        words = [word() for _ in range(rng.randint(1, 60))]
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + [line[rng.randint(0, 30) :]] * (i % 3 > 0) + words[at:])))
    docs.append((70, "long " + " ".join(word() for _ in range(3000)) + line))
    return docs


@pytest.mark.parametrize("lane,piece", [(2000, 2_000_000), (3, 900)])
def test_against_brute_force(spark, monkeypatch, lane, piece):
    docs = corpus()
    if lane == 3:  # small bounds, in this process
        monkeypatch.setattr(S, "LANE", lane)
        monkeypatch.setattr(S, "PIECE", piece)
        got = local(docs, 3)
    else:
        df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, row int, target string, n_bytes int")
        got = [tuple(r) for r in S.dedup(df).collect()]
    assert sorted(got, key=str) == brute(docs)


def local(docs, n):
    """The steps without Spark."""
    import pyarrow as pa

    ids = pa.array([d for d, _ in docs], pa.int64())
    rows = pa.array([int.from_bytes(hashlib.sha256(f"{d}{t}".encode()).digest()[:7], "big") for d, t in docs], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, rows, pa.array([t or "" for _, t in docs])], names=["i", "r", "t"])

    def step(run, rows):
        out = []
        for t in range(n):
            own = sorted((r for r in rows if r[0] == t), key=lambda r: r[1])
            if own:
                for b in run(iter([S.rows_of(own)])):
                    out += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        return out

    spread = lambda run: [r for b in run(iter([batch.slice(i, 7) for i in range(0, len(docs), 7)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    flags = step(S.entry_rows(n), spread(S.anchor_rows(n)))
    texts = spread(S.text_rows(n))
    parts = step(S.suffix_rows(n), step(S.context_rows(n), [f for f in flags if f[1] == S.ASKED] + texts))
    first = [f for f in flags if f[1] == S.FULL] + parts
    out = []
    for t in range(n):
        own = [r for r in first if r[0] == t] + [r for r in texts if r[0] == t]
        if own:
            for b in S.cover_rows(S.digest_batch)(iter([S.rows_of(own)])):
                out += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
    return out


def test_empty_table_and_cut(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert S.dedup(none).collect() == [] and S.cut_repeats(none).collect() == []
    line = "é" * 40
    df = spark.createDataFrame([(1, line, "a", "s", 40), (2, "x" + line + "y", "b", "s", 42), (3, None, "c", "s", 0)], none.schema)
    got = {r["doc_id"]: r for r in S.cut_repeats(df).collect()}
    assert got[1]["text"] == line and got[2]["text"] == "xy" and got[2]["n_chars"] == 2 and got[2]["lang"] == "b" and got[3]["text"] is None
