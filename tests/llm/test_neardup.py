import collections

import numpy as np
import pyarrow as pa

from provlake.llm import bagminhash, neardup, paragraph_dedup
from provlake.llm.components import components


def shingle_bag(text):
    w = (text or "").encode().split()
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def similarity(a, b):
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 1.0


def brute(docs):
    bags = [shingle_bag(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                up[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [docs[i][0] for i in g if docs[i][0] is not None]
        out += [(docs[i][0], min(ids, default=None), len(g)) for i in g]
    return sorted(out, key=str)


def corpus():
    rng = np.random.RandomState(5)
    vocab = np.array([f"w{i}" for i in range(400)])
    base = rng.choice(vocab, 150)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (6, "one two three"), (None, "one two"), (7, "x " * 300), (8, "x " * 280)]
    for i in range(60):  # a family around one text, some of whose members are alike only through others
        t = base.copy()
        for _ in range(i % 12):
            t[rng.randint(0, 150)] = rng.choice(vocab)
        docs.append((100 + i, " ".join(t)))
    for i in range(40):
        docs.append((200 + i, " ".join(rng.choice(vocab, rng.randint(1, 200)))))
    docs += [(300, docs[20][1]), (20, docs[20][1]), (20, docs[20][1])]
    return docs


def test_classes_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "k", b"s") for d, t in docs], "doc_id long, text string, id int, row string, sig binary")
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(df).collect()]
    assert sorted(got, key=str) == brute(docs)
    kept = neardup.first_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, c, _ in brute(docs)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(none).collect() == [] and paragraph_dedup.dedup(none).collect() == []


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    docs = corpus()
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_signatures_are_unbiased():
    rng = np.random.RandomState(1)
    a = {i: rng.randint(1, 7) for i in range(200)}
    b = {i: v if rng.rand() < 0.8 else rng.randint(1, 7) for i, v in a.items() if rng.rand() < 0.9}
    true = sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(max(v, b.get(k, 0)) for k, v in a.items())
    agree = []
    for s in range(40):
        h = lambda d: np.array([hash((s, k, "z")) & (2**63 - 1) for k in d], np.uint64)  # noqa: B023, E731
        sig = bagminhash.signatures(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[h(a), h(b)], np.r_[list(a.values()), list(b.values())], 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


def test_overlap_blocks_are_exact():
    texts = [t or "" for _, t in corpus()][9:40]
    n = np.arange(len(texts))
    got = neardup.by_overlap(texts, n, n, 0.8)
    bags = [shingle_bag(t) for t in texts]
    want = np.array([[similarity(x, y) >= 0.8 for y in bags] for x in bags])
    np.fill_diagonal(got, True)  # what only one item has isn't counted, so an item with itself is left out
    assert (got == want).all()


def test_components(spark):
    rng = np.random.RandomState(2)
    pairs = [(int(a), int(b)) for a, b in rng.randint(0, 120, (70, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            up[find(a)] = find(b)
    assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert len({(find(x), r) for x, r in got.items()}) == len({find(x) for x in got}) == len(set(got.values()))


def test_paragraphs_against_brute_force(spark):
    rng = np.random.RandomState(4)
    vocab = np.array([f"v{i}" for i in range(3000)])
    passage = " ".join(rng.choice(vocab, 60))
    docs = [(1, None), (2, ""), (None, "a b c d e f g h " + passage)]
    for i in range(10, 40):
        w = [" ".join(rng.choice(vocab, rng.randint(20, 60))) for _ in range(3)]
        if i % 3 == 0:
            w.insert(1, passage)
        docs.append((i, ("\n" if i % 2 else " ").join(w)))
    docs += [(50, docs[5][1]), (50, docs[5][1])]
    found = []
    for d, t in docs:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, number, a, b, _, size, _, _ = paragraph_dedup.paragraphs(raw, np.array([0, len(raw)]))
        assert size.sum() == len(raw.tobytes().split())
        found.append([(int(k), tuple(raw[x:y].tobytes().split()), int(n)) for k, x, y, n in zip(number, a, b, size, strict=True)])
    bag = lambda w: frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4)))
    contents = {}
    for (d, t), ps in zip(docs, found, strict=True):
        for k, w, n in ps:
            if n >= paragraph_dedup.LEAST_WORDS:
                key = (-1 if d is None else d, k)
                contents[w] = min(contents.get(w, key), key)
    up = {w: w for w in contents}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in contents:
        for y in contents:
            a, b = bag(x), bag(y)
            if x != y and len(a & b) >= 0.8 * len(a | b):
                up[find(x)] = find(y)
    first = {}
    for w, key in contents.items():
        first[find(w)] = min(first.get(find(w), key), key)
    want = []
    for (d, t), ps in zip(docs, found, strict=True):
        gone = [k for k, w, n in ps if n >= paragraph_dedup.LEAST_WORDS and first[find(w)] != (-1 if d is None else d, k)]
        size = np.array([n for _, _, n in ps])
        want.append((d, len(paragraph_dedup.runs_of(np.array(gone, int), size))))
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_gone int")
    got = [(r["doc_id"], r["n_gone"]) for r in paragraph_dedup.dedup(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(n > 0 for d, n in want if d and d % 3 == 0) >= 9


def test_block_links_join_only():
    x = np.arange(4)
    like = np.ones((4, 4), bool)
    assert len(neardup.joining(like, x, x, np.array([1, 1, 2, 3]))) == 2
    rows = [(2, i, i, t) for i, t in enumerate(["a b c d e f"] * 3)]
    (out,) = neardup.block_rows(neardup.by_overlap, 0.8, True)(iter([pa.RecordBatch.from_arrays([pa.array([1] * 3), pa.array([0] * 3), pa.array([0] * 3), *(pa.array(c) for c in zip(*rows, strict=True))], names=list("kijsabc"))]))
    assert out.num_rows == 2


def test_passages_in_short_lines_and_short_pieces_go(spark):
    rng = np.random.RandomState(5)
    words = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    long, lines, verse = " ".join(words(400)), words(240), words(240)
    cut = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [long, long, cut(lines, 3), cut(lines, 3), cut(verse, 6), cut(verse, 6)]
    texts += [" ".join(words(40)) + "\n" + cut(lines, 3) + "\n" + " ".join(words(40)), "one two\nthree", "one two\nthree"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in paragraph_dedup.dedup(df, with_kept=True).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[4] == texts[4] and got[7] == texts[7] and got[8] == texts[8]
    assert [len(got[i].split()) for i in (1, 3, 5)] == [0, 0, 0]
    # but for the new lines around it, the passage goes
    assert got[6].startswith(texts[6].split("\n")[0]) and got[6].endswith(texts[6].split("\n")[-1]) and len(got[6].split()) == 80


def test_bands_of_very_many_items(spark, monkeypatch):
    """Bands of more than a few items meet through a second band only; the classes stay the same."""
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 4)
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(df, large=5).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_all_repeated_paragraphs_go(spark):
    line = "one two three four five six seven"
    df = spark.createDataFrame([(1, line + "\nsome words of its own here"), (2, "other words of another text\n" + line)], "doc_id long, text string")
    few = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.dedup(df, least_run=0).collect()}
    assert few[1] == 0 and few[2] == len(line) and {r["n_removed"] for r in paragraph_dedup.dedup(df).collect()} == {0}


def test_large_bands_lose_no_link_of_one_band(spark):
    """Items that share one band only are linked, however many items the band has."""
    rng = np.random.RandomState(6)
    base = [f"w{x}" for x in rng.randint(0, 10**6, 60)]
    texts = [" ".join(base), " ".join([*base[:-3], "a", "b", "c"])] + [" ".join(f"w{x}" for x in rng.randint(0, 10**6, 60)) for _ in range(4)]
    assert 0.8 <= similarity(*map(shingle_bag, texts[:2])) < 1
    docs = neardup.plain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])
    (made,) = neardup.sketch_rows(iter([batch.select(["doc_id", "row", "text"])]))
    # the two aren't the band's least, which others are measured with
    ids = made.column("id").to_pylist()
    order = {i: n for n, i in enumerate(ids)}
    new = lambda i: order[i] if order[i] > 1 else 100 + order[i]
    key = np.array([7], np.int64).tobytes()
    rows = [(d, r, new(i), s, key) for d, r, i, s in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), ids, made.column("sig").to_pylist(), strict=True)]
    sketches = spark.createDataFrame(rows, "doc_id long, row long, id long, sig binary, bands binary")
    for large in (2, 1000):
        labels = neardup.links(docs.select("row", "text"), sketches, large=large)
        got = {} if labels is None else {r["id"]: r["root"] for r in labels.collect()}
        assert set(got) == {100, 101} and got[100] == got[101], large


def test_a_large_family_with_few_strangers_makes_few_rows(spark, monkeypatch):
    """Items of a band's largest family don't meet each other again, and a band's rows are made by one join."""
    rng = np.random.RandomState(7)
    words = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    base, other = words(60), words(60)
    texts = [" ".join([*base[:-1], f"v{i}"]) for i in range(120)] + [" ".join([*other[:-1], f"v{i}"]) for i in range(2)] + [" ".join(words(60))]
    docs = neardup.plain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])
    (made,) = neardup.sketch_rows(iter([batch.select(["doc_id", "row", "text"])]))
    key = np.array([7], np.int64).tobytes()  # one band of all, whose least item is of the large family
    rows = [(d, r, 1000 + d, s, key) for d, r, s in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), made.column("sig").to_pylist(), strict=True)]
    sketches = spark.createDataFrame(rows, "doc_id long, row long, id long, sig binary, bands binary")
    sizes, joins, blocks = [], [], neardup.blocks

    def counted(rows, payload):
        out = blocks(rows, payload)
        sizes.append(out.count())
        joins.append(sum("Join" in x and "(key#" in x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return out

    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "blocks", counted)
    got = {r["id"]: r["root"] for r in neardup.links(docs.select("row", "text"), sketches).collect()}
    assert set(got) == set(range(1000, 1122)) and len({got[i] for i in range(1000, 1120)}) == 1 and got[1120] == got[1121] != got[1000]
    # 120 items meet one block of three, which meets 15 blocks and itself
    assert sizes[0] == 120 + 3 * 16 and joins == [1] * len(joins), (sizes, joins)
