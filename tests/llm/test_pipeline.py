import numpy as np
import pandas as pd

import corpus_pipeline
from tests.llm.test_neardup import brute as classes
from tests.llm.test_quality import base

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        at = spark.conf.get("spark.checkpoint.dir") + f"/test-{len(seen)}"
        out.write.mode("overwrite").parquet(at)
        docs = spark.read.schema(docs.schema).parquet(at)
        seen.append(docs.toPandas())
    good, unique, cut, clean = (d.set_index("doc_id").sort_index() for d in seen[1:])
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    of = labels.merge(seen[0], on="doc_id")
    kept = of.doc_id.isin(good.index)
    assert kept[of.quality == 1].mean() > 0.95 and len(good) < len(seen[0])
    want = {c for _, c, _ in classes(list(zip(good.index.tolist(), good.text.tolist(), strict=True)))}
    assert set(unique.index) == want
    first: dict[bytes, int] = {}
    for i, t in unique.text.items():
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in unique.text.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        start, chars = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[start : start + n].any():
                chars.append(c)
            start += n
        assert cut.text[i] == "".join(chars) and cut.n_chars[i] == len(chars)
    for i, t in clean.text.items():
        assert not base(t) or "[" in t
        assert t == cut.text[i] or base(cut.text[i]) or "[SECRET]" in t
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(last.doc_id) == set(clean.index)
    assert (last.groupby("sequence_id").length.sum() <= 2048).all()


COLUMNS = "doc_id long, text string, lang string, n_chars long, _row string, _id int, score string, predicted int, base int, `kept` string, `_null` boolean"


def edges(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text, and names that stages use themselves."""
    long = " ".join(f"word{i} of a long text" for i in range(30_000))
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text of the same number"), (5, long), (6, "write to a@b.org or +1 (811) 555-3281"), (None, "one two three four five six")]
    full = [(i, t, "en", len(t or ""), f"r{k}", k, "s", 7, 3, "k", True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame([*full, (None,) * 11], COLUMNS)


def test_stages_on_edges(spark):
    docs = edges(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        if stage is not corpus_pipeline.quality:
            assert all((r["_row"], r["score"], r["predicted"], r["kept"]) in ((f"r{r['_id']}", "s", 7, "k"), (None,) * 4) for r in rows)
        assert stage(spark, docs.limit(0), DATA).collect() == []
    one = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    # rows without words are one class, equal texts another; of a class's rows the least number stays, nulls only without others
    assert sorted((r["doc_id"], (r["text"] or "")[:8]) for r in one) == [(1, ""), (4, "another "), (4, "one two "), (5, "word0 of"), (6, "write to")]
    cut = {r["_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, DATA).collect()}
    assert cut[0] is None and cut[1] is None and cut[2] == "" and cut[4] == cut[5]
    clean = {r["_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.personal_data(spark, docs, DATA).collect()}
    assert clean[8] == ("write to [EMAIL] or [PHONE]", 27) and clean[0][0] is None
    last = corpus_pipeline.packed(spark, docs, DATA)
    assert last.select("doc_id").where("doc_id is null").count() == 3 and last.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_packing_of_the_last_stage(spark):
    """Every document's ids, in order and whole, with the end id; sequences without gaps."""
    import zlib

    from provlake.llm.common import vocabulary
    from provlake.llm.tokens import cache_for

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lib = cache_for(vocabulary("byte_bpe_50k.json"))
    want = {r["doc_id"]: np.frombuffer(lib._encode([r["text"] or ""])[0], "<u4").tolist() + [0] for r in docs.collect()}
    got = corpus_pipeline.packed(spark, docs, DATA).collect()
    pieces = {}
    for r in got:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for d, p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and p[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:])) and p[-1][1] + p[-1][2] == len(want[d])
    assert set(pieces) == set(want)
