import collections
import hashlib
import re

import numpy as np
import pytest

from provlake.llm import compression_quality, pii, quality_trees

DATA = "/root/testdata/sf0.01"
TEXTS = ["", " ", "a", "a b c a b c\nx\nx\n\nx", "é ö #|% " * 30, "w\x0bv u " * 60, "x" * 9000, "same line here\n" * 40]


def test_statistics_against_brute_force():
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        got = quality_trees.statistics(t)[:5]
        assert got == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)), t[:30]
    ids = np.random.RandomState(0).randint(0, 5, 200)
    assert quality_trees.repeated_words(ids, 5) == quality_trees.repeated_words(ids, 3_000_000)


def test_trees_are_monotone_and_learn():
    rng = np.random.RandomState(0)
    x = rng.rand(3000, 3)
    y = ((x[:, 0] < 0.5) & (x[:, 1] + 0.3 * rng.rand(3000) > 0.5)).astype(float)
    f = quality_trees.boost(x, y, np.array([-1, 1, 0]), trees=25)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.9
    line = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.8), np.full(50, 0.3)])
    assert (np.diff(f.raw(line)) <= 1e-9).all()
    assert (np.diff(f.raw(line[:, [1, 0, 2]])) >= -1e-9).all()
    assert quality_trees.boost(x[:0], y[:0], np.zeros(3)).score(x[:2]).tolist() == pytest.approx([0.982, 0.982], abs=1e-3)


def edge(spark):
    rows = [(i, t, 0.5, 7) for i, t in enumerate(TEXTS)] + [(None, "null id " * 60, 0.1, 1), (1, None, 0.0, 0), (2, "a", 0.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, kept int")


def test_edges(spark):
    df = edge(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_trees.judge(df, labels).collect()
    assert len(got) == df.count() and all(r["base_failed"] for r in got if r["n_words"] < 50) and not any(r["kept"] and r["base_failed"] for r in got)
    got = compression_quality.classify(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert quality_trees.judge(df.limit(0), labels.limit(0)).collect() == [] and compression_quality.classify(df.limit(0), labels.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = compression_quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    kept = quality_trees.judge(docs, labels).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in kept]) > 0.95


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def pii_texts():
    rng = np.random.RandomState(7)
    bits = ["a@b.c", "a@b.c_d@e.f", "x..y%+@q-r.s.t", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (811) 555-3281", "+49.30-1234567", "811 555-3281", "é", "漢", " ", "-", "12", "5", "\n", "token 4111111111111111", "tel ", "ann (at) host (dot) org"]
    return ["", None, "9" * 30000, "a" * 60000 + "@", "1 " * 20000, "+1" + " 2" * 9000] + ["".join(rng.choice(bits, rng.randint(1, 14))) for _ in range(400)]


def test_spans_against_python(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, base string, spans int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(got[i]["spans"].split(",")) | {""}
    assert pii.report(df.limit(0)).collect() == []


def test_digits_that_stand_apart(spark):
    texts = ["pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "call +1 2 3 4 5 6 7 8 9 today", "+1-2.3(4)5 6 7 8 9", "only 1 digit, and + 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        want = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t)]
        assert len(want) == (i < 4) and got[i]["spans"] == ",".join(want) and got[i]["n_card"] == (i < 2) and got[i]["n_phone"] == (i in (2, 3))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {0: "pay [CARD] now", 1: "[CARD]", 2: "call [PHONE] today", 3: "[PHONE]", 4: texts[4]}


def planted_texts():
    """(text, kind, span that no base rule finds or None, whether it should be added)."""
    rng = np.random.RandomState(11)
    out = []
    for i in range(6000):
        a, b, c = rng.randint(200, 999), rng.randint(100, 999), rng.randint(1000, 9999)
        card = "".join(map(str, [4, *rng.randint(0, 10, 14)]))
        card += next(d for d in "0123456789" if luhn(card + d))
        four = [card[j : j + 4] for j in (0, 4, 8, 12)]
        name, host = f"ann{'abc'[i % 3]}", f"host{'xyz'[i % 3]}"
        out.append([
            (f"please write to {name}@{host}.org soon", "email", None, False),
            (f"please write to {name}@{host}.org soon", "email", None, False),
            (f"please write to {name} (at) {host} (dot) org soon", "email", f"{name} (at) {host} (dot) org", True),
            (f"so call +1 ({a}) {b}-{c} today", "phone", None, False),
            (f"so call +1 {a} {b} {c} today", "phone", None, False),
            (f"so call {a}-{b}-{c} today", "phone", f"{a}-{b}-{c}", True),
            (f"so call ({a}) {b}-{c} today", "phone", f"({a}) {b}-{c}", True),
            (f"an order no {a}-{b}-{c} was shipped", "phone", f"{a}-{b}-{c}", False),
            (f"an order no {a}{b}{c}, shipped", "phone", f"{a}{b}{c}", False),
            (f"with card {' '.join(four)} paid", "card", None, False),
            (f"with card {'.'.join(four)} paid", "card", ".".join(four), True),
        ][i % 11])
    return out


def test_proposals_are_added_on_a_large_table(spark):
    texts = planted_texts()
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    added = {True: {k: [] for k in pii.KINDS}, False: {k: [] for k in pii.KINDS}}
    for i, (t, kind, span, good) in enumerate(texts):
        if span is not None:
            assert not base(t)
            added[good][kind].append(got[i] == f"{kind}:{t.index(span)}:{t.index(span) + len(span)}")
            assert good or got[i] in ("", f"{kind}:{t.index(span)}:{t.index(span) + len(span)}")
    assert all(np.mean(added[True][k]) > 0.95 for k in ("email", "phone", "card"))
    assert np.mean(added[False]["phone"]) < 0.05


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.c and +1 (811) 555-3281!", "x", 30, 1), (2, "clean", "y", 5, 2), (3, None, "z", 0, 3), (1, "clean", "y", 5, 2)], "doc_id long, text string, lang string, n_chars long, base int")
    got = sorted((tuple(r) for r in pii.redact(df).collect()), key=str)
    assert got == sorted([(1, "é [EMAIL] and [PHONE]!", "x", 22, 1), (2, "clean", "y", 5, 2), (3, None, "z", 0, 3), (1, "clean", "y", 5, 2)], key=str)
    assert pii.redact(df.limit(0)).collect() == []


def test_secrets_and_dotted_addresses(spark):
    rng = np.random.RandomState(5)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(900)]
    ips = [".".join(map(str, rng.randint(1, 255, 4))) for _ in range(900)]
    texts, want = [], []
    for i, (h, ip) in enumerate(zip(hexes, ips, strict=True)):
        texts.append([f'set token = "{h}" here', f"see {h} here", f"at {ip} today", f"at {ip.replace('.', '[.]')} today", "the averylongwordwithoutanydigits stays, and so does 2024-05-01", "word " * 5][i % 6])
        want.append([f"secret:13:{13 + 32}", "secret:4:36", f"ip:3:{3 + len(ip)}", f"ip:3:{3 + len(ip) + 6}", "", ""][i % 6])
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = [got[i]["spans"] == w for i, w in enumerate(want)]
    for j in range(6):
        assert np.mean(right[j::6]) > 0.95, texts[j]
    assert all(got[i]["n_spans"] == (want[i] != "") for i in range(len(want)) if right[i]) and sum(r["n_secret"] for r in got.values()) > 280


def test_long_text_of_addresses(spark):
    """Time goes by the number of spans, whatever their text's length: the time of a text without any is taken off."""
    import time

    def timed(text, run=pii.report):
        df = spark.createDataFrame([(0, text)], "doc_id long, text string")
        began = time.time()
        row = run(df).first()
        return row, time.time() - began

    addresses = [" ".join(f"a{i}@b{i}.org" for i in range(n)) for n in (0, 3000, 24000)]
    timed(addresses[1])
    (_, none), (few, short), (many, long) = map(timed, addresses)
    assert few["n_email"] == 3000 and many["n_email"] == 24000
    assert long - none < 3 * 8 * max(short - none, 1)
    row, _ = timed(" ".join(f"call +1 (811) 555-{i:04d} or 4111 1111 1111 1111;" for i in range(2500)))
    assert row["n_phone"] == 2500 and row["n_card"] == 2500
    row, _ = timed(addresses[1], pii.redact)
    assert row["text"] == " ".join(["[EMAIL]"] * 3000)

def test_trees_on_rows_left_out(spark):
    """Fitted on labels of two thirds of the rows, judged on the rest."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    own = labels.where("crc32(cast(doc_id as string)) % 3 <> 1")
    out = quality_trees.judge(docs, own).join(labels.where("crc32(cast(doc_id as string)) % 3 = 1"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert len(out) > 60 and np.mean([r["kept"] == (r["quality"] == 1) for r in out]) > 0.93
