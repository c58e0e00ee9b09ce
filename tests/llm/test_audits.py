import hashlib
import itertools
import re

import duckdb
import pytest

from provlake.llm import fill_in_middle, filter_audit

DATA = "/root/testdata/sf0.001"


def by_sql(spark, frame, sql, **tables):
    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(name, rows.toPandas())
    want = c.sql(sql)
    got = frame.select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)



TEXTS = [None, "", "plain words, and more.", "has <P> in it", "<S>", "x<M>", "a\x01b\x02c\x010\x011 \x01\x01\x02\x02", "\x02", "日本語 text 🎉 b", "one", "...", "a\nb\r\n\n", "0\x01", "aß\x00b" * 40, "word " * 30_000, "$1 \\ $0", "<P", "P>x<", "<S<S<M"]


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text))


def test_middles_against_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(None, "no id here"), (3, "twice"), (3, "twice"), (-7, "minus one")]
    df = spark.createDataFrame([(d, t, 5, "x", "y") for d, t in rows], "doc_id long, text string, n int, form string, prefix string")
    got = [tuple(r) for r in fill_in_middle.digests(df).collect()]
    assert sorted(got, key=str) == sorted((brute_middle(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_pieces(spark):
    df = spark.createDataFrame([(i, "The quick, brown fox\x01 jumps \x02over.") for i in range(60)], "doc_id long, text string")
    for r in fill_in_middle.transform(df, seed=7, transformed=100, suffix_first=50).collect():
        assert r["prefix"] + r["middle"] + r["suffix"] == r["text"] and r["form"] != "plain"


def test_middles_of_no_rows(spark):
    assert fill_in_middle.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_middles_agree_with_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by_sql(spark, fill_in_middle.digests(docs), fill_in_middle.SQL, documents=docs.select("doc_id", "text"))


def fails(text, copy):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    bits = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), copy]
    return {f for f, b in zip("ABCDE", bits) if b}


def brute_audit(docs, labels):
    rows = []
    for d, t, s in docs:
        copy = d is not None and any(x is not None and x < d and (u or "") == (t or "") for x, u, _ in docs)
        mine = [x for x in labels if x[0] is not None and x[0] == d]
        rows.append((s or "", fails(t, copy), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in sorted({r[0] for r in rows}):
        own, first = [r for r in rows if r[0] == part], {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                removed_before = len(own) - len(left)
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                assert removed_before >= redundant
                first[order, step] = (part, order, step, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (order, step), row in first.items():
            out.append((*row, sum(x[4] for (o, s), x in first.items() if o[s - 1] == order[step - 1])))
    return out


def audited():
    varied = " ".join(f"word{i}" for i in range(250))
    dull = "same " * 300
    docs = [(1, None, None), (2, "", ""), (3, " \n", "a"), (4, varied, "a"), (5, varied, "b"), (5, varied, "b"), (6, dull, "a"), (7, dull + "$", "a"), (8, "ABC " + varied, "b"), (9, ("ABC " * 60) + varied, "b")]
    docs += [(None, varied, "a"), (None, "unnamed", "a"), (None, "unnamed", "a"), (10, "unnamed", "a"), (11, varied + "   a\x0bb", "c"), (4, "other text of the same id", "a"), (4, "other text of the same id", "a"), (12, "É" * 30, "c")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (6, 0, 0), (8, 1, 1), (None, 1, 1), (99, 1, 1), (10, None, 1)]
    return docs, labels


def test_audit_against_plain_python(spark):
    docs, labels = audited()
    df = spark.createDataFrame([(d, t, s, 1, "m", b"h", 2) for d, t, s in docs], "doc_id long, text string, source string, n int, mask string, hash binary, part int")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    got = [tuple(r) for r in filter_audit.audit(df, marks).collect()]
    assert sorted(got) == sorted(brute_audit(docs, labels))


def test_audit_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("source", ["driver", "made"])
def test_audit_agrees_with_sql(spark, source):
    if source == "driver":
        docs, marks = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
        docs = docs.select("doc_id", "text", "source")
    else:
        rows, labels = audited()
        docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string, source string")
        marks = spark.createDataFrame([r for r in labels if None not in r], "doc_id long, quality int, toxic int")
    by_sql(spark, filter_audit.audit(docs, marks), filter_audit.SQL, documents=docs, labels=marks)
