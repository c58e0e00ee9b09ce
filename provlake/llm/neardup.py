"""MinHash near-dedup of documents: BagMinHash signatures, bands, and exact overlap of shingle multisets.

Two texts are near duplicates if the weighted Jaccard similarity of their five-word shingles, with counts, is at
least ``SIMILARITY``; classes are the components of such links. Texts of the same words are one item, known by a
hash of its words.

1. signatures of all texts; each batch puts out one entry for each (band, item)
2. a band's entries meet in one partition. Items of a batch that share a band are linked to the batch's least item
   on the spot, so a band that a third of all texts share has one entry a batch, not one a text
3. candidate pairs join each item to its band's least item. A hub's members are dealt in salted blocks, so its text goes
   to each block once and not to each pair; members are measured exactly on the texts, as they stream by
4. components of items that have like signatures (``SLACK``, about five standard deviations, below the threshold) and
   share a band are one family. Hubs have shown most of them in step 3. Where a band's items are still of several, those
   outside its largest family meet all of the band in blocks of ``BLOCK``; items of the largest one needn't meet each
   other, so a large family with a few strangers costs as many rows as it has items for each block of strangers. Bands of
   more than ``LARGE`` items come last, when fewer are apart: that is an order only, and no band's pairs are left out. The
   work of a band whose very many items are not alike is quadratic, dealt out by pairs of blocks. A family of several
   components of step 3 meets in blocks in the same way, and a block pair measures exactly whatever is in different
   components. It puts out no more links than join its components, so no link is lost to the star shape of step 3, and no
   group puts out all its pairs

Edge cases: null and empty texts and those of blanks only have no words, and are one class; texts of one to four
words have one shingle; repeated rows are in their class each; a null doc_id is kept, and the least of a class only
if it has no other; an empty table gives no rows; other columns are ignored by ``classes``, kept by ``first_of_each``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm import blobs, shingles
from provlake.llm.bagminhash import SLOTS, band_keys, signatures
from provlake.llm.common import forget, lean, mix, small_batches, stored
from provlake.llm.components import components
from provlake.llm.suffix_dedup import by_target, gathered, rows_of

SIMILARITY = 0.8
ROWS = 4
BLOCK = 512
LARGE = 32 * BLOCK
COLUMNS = 4096
SLACK = 0.18
BAND, MEMBER = 0, 1
MEMBERS = "key long, id long, hub long"


def measured(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(content hash, number of words, distinct shingles with counts) of texts laid end to end."""
    n = len(starts) - 1
    text, _, _, value = shingles.words(raw, starts)
    own, shingle, level = shingles.numbered(*shingles.shingles(text, value, n))
    last = np.ones(len(own), bool)
    last[:-1] = (own[1:] != own[:-1]) | (shingle[1:] != shingle[:-1])
    return shingles.content(text, value, n), np.bincount(text, minlength=n), (own[last], shingle[last], level[last])


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id (may be null), id, sig (a byte of each slot), bands."""
    for b in batches:
        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        done = 0
        for doc, _, raw, starts, _ in gathered(iter([b])):
            ids, n_words, (own, shingle, weight) = measured(raw, starts)
            sig = signatures(own, shingle, weight, len(doc))
            keys = band_keys(sig, ROWS).view(np.int64)
            keys_list = [k.tobytes() if n else b"" for k, n in zip(keys, n_words.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64(), mask=null[done : done + len(doc)]),
                    pa.array(ids.view(np.int64)),
                    pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary()),
                    pa.array(keys_list, pa.binary()),
                ],
                names=["doc_id", "id", "sig", "bands"],
            )
            done += len(doc)


def stars(key: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, item), ordered, with the key's least item and whether the key has several."""
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
    key, item = key[new], item[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    of = np.cumsum(head) - 1
    return key, item, item[head][of] if len(key) else item, (np.bincount(of) > 1)[of] if len(key) else head


def band_rows(n: int):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            parts = [np.frombuffer(k, np.int64) for k in b.column(1).to_pylist()]
            if not sum(map(len, parts)):
                continue
            key, item, hub, several = stars(np.concatenate(parts), np.repeat(ids, [len(p) for p in parts]))
            found = []
            target = (mix(key.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            local = np.flatnonzero(several)
            for t, s in by_target(target[local], n):
                k = local[s]
                found.append((t, MEMBER, blobs.pack(key[k], item[k], hub[k])))
            sent = np.flatnonzero(item == hub)
            for t, s in by_target(target[sent], n):
                k = sent[s]
                found.append((t, BAND, blobs.pack(key[k], item[k])))
            yield rows_of(found)

    return bands


def member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, hub) of the items of bands with several."""
    parts = []
    for b in batches:
        for kind, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if kind == BAND:
                parts.append(blobs.unpack(payload))
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in blobs.unpack(payload)], names=["key", "id", "hub"])
    if parts:
        key, item, hub, several = stars(*blobs.joined(parts, 2))
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, item, hub)], names=["key", "id", "hub"])


def elements(texts: pa.Array) -> list[np.ndarray]:
    """The multiset of each text's shingles, as sorted hashes of (shingle, which occurrence)."""
    out: list[np.ndarray] = []
    zero = pa.array(np.zeros(len(texts), np.int64))
    for _, _, raw, starts, _ in gathered(iter([pa.RecordBatch.from_arrays([zero, zero, texts], names=["d", "r", "t"])])):
        _, _, (own, shingle, weight) = measured(raw, starts)
        times = np.repeat(np.arange(len(own)), weight)
        level = np.arange(len(times)) - np.repeat(np.cumsum(weight) - weight, weight)
        value = mix(shingle[times] + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        value = value[np.lexsort((value, own[times]))]
        ends = np.searchsorted(own[times], np.arange(len(starts)))
        out += [value[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out


HUB, LEAF = 0, 1


def star_rows(threshold: float, at_once: int = 64):
    """(a, b) of the members of a block that are similar to its hub, whose row comes first."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, name = None, 0
        for b in batches:
            side, ids, texts = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            out: list[tuple[int, int]] = []
            for i in range(0, b.num_rows, at_once):
                part = slice(i, min(i + at_once, b.num_rows))
                for s, x, e in zip(side[part].tolist(), ids[part].tolist(), elements(texts.slice(i, at_once)), strict=True):
                    if s == HUB:
                        hub, name = e, x
                    elif hub is not None and shingles.overlap(hub, e) >= threshold:
                        out.append((name, x))
            p, q = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])

    return similar


def starred(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a: hub, b: member) that are similar by their texts (id, text)."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    own = salts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("salt"), F.lit(HUB).alias("side"), F.col("a").alias("id"))
    salted = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("_n")).cast("int").alias("salt"), F.lit(LEAF).alias("side"), F.col("b").alias("id"))
    rows = own.unionByName(salted).join(texts.select("id", "text").hint("merge"), "id").select("hub", "salt", "side", "id", "text")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side").mapInArrow(lean(star_rows(threshold)), "a long, b long")


class Union:
    """Joins roots and tells whether two were apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def joining(like: np.ndarray, x: np.ndarray, y: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (rows of x, of y) that are alike, as few as join their components."""
    i, j = np.nonzero(like & (root[x][:, None] != root[y][None, :]))
    union = Union()
    return [(p, q) for p, q in zip(x[i].tolist(), y[j].tolist(), strict=True) if union.join(int(root[p]), int(root[q]))]


def by_signature(payload: list[bytes], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
    return np.array([(sig[y] == sig[i]).mean(axis=1) >= least for i in x]).reshape(len(x), len(y))


def by_overlap(payload: list[str], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Exact similarities by products of incidence matrices, some columns (elements of two items or more) at a time."""
    sets = elements(pa.array(payload, pa.string()))
    sizes = np.array([len(e) for e in sets])
    item = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = (count > 1)[column]
    item, column = item[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    item, column = item[order], column[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[item[own], column[own] - c] = 1
        common += m[x] @ m[y].T
    union = sizes[x][:, None] + sizes[y][None, :] - common
    return (common >= least * union - 1e-6) & (union > 0)


def block_rows(alike, least: float, ids_out: bool):
    """Links within block pairs, which come sorted: (a, b) of items, or of their components."""

    def links_of(rows: list[tuple]) -> pa.RecordBatch:
        side, ids, root, payload = zip(*rows, strict=True)
        side, ids, root = np.array(side), np.array(ids, np.int64), np.array(root, np.int64)
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: the block meets itself
        if side[0] == 2:  # what is in its largest component needn't be compared with the same
            own, count = np.unique(root, return_counts=True)
            x = np.flatnonzero(root != own[count.argmax()])
        found: list[tuple[int, int]] = []
        if len(x) and len(y) and (root != root[0]).any():
            found = joining(alike(list(payload), x, y, least), x, y, root)
        p, q = np.array(found, np.int64).reshape(-1, 2).T
        a, b = (ids[p], ids[q]) if ids_out else (root[p], root[q])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != now:
                    if held:
                        yield links_of(held)
                    now, held = (key, i, j), []
                held.append(tuple(row))
        if held:
            yield links_of(held)

    return block_links


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree enough."""
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("_x"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(r.column(i).to_pylist()), np.uint8).reshape(r.num_rows, -1) for i in (2, 3))
            yield r.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "_x", "_y").mapInArrow(lean(run), "a long, b long")


def blocks(rows: DataFrame, payload: str) -> DataFrame:
    """(key, i, j, side, id, root, payload) of rows with what ``apart`` tells of their key.

    Blocks of items outside their key's main component meet all blocks; those of the main one meet only these, as its
    items are together already. The items of a key that has no more than one block meet in it.
    """
    one = F.col("n") <= BLOCK
    outer = F.when(one, 1).otherwise(F.ceil(F.col("rest") / BLOCK))
    inner = F.when(one, 0).otherwise(F.ceil((F.col("n") - F.col("rest")) / BLOCK))
    out = rows.withColumn("_outer", outer.cast("int")).withColumn("_inner", inner.cast("int")).withColumn("_in", ~one & (F.col("root") == F.col("main")))
    place = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    out = out.withColumn("own", F.when(F.col("_in"), F.col("_outer") + place("_inner")).otherwise(place("_outer")))
    last = F.when(F.col("_in"), F.col("_outer")).otherwise(F.col("_outer") + F.col("_inner")) - 1
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    out = out.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "id", "root", payload)
    return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def apart(rows: DataFrame, least: int) -> DataFrame:
    """(key, n, rest, main) of keys whose n items, ``least`` or more, are of several components.

    main is one that has most of them, and rest are in others.
    """
    each = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    of = each.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("_most"), F.max_by("root", "c").alias("main"))
    return of.where(f"_most < n and n >= {least}").select("key", "n", (F.col("n") - F.col("_most")).alias("rest"), "main")


def links(docs: DataFrame, sketches: DataFrame, threshold: float = SIMILARITY, large: int = LARGE) -> DataFrame | None:
    """(id, root) of the items that have a near duplicate; None if there are none."""
    spark = docs.sparkSession
    n = blobs.partitions(docs)
    members = stored(blobs.exchange(sketches.select("id", "bands").mapInArrow(lean(band_rows(n)), blobs.ROW), n).mapInArrow(member_rows, MEMBERS), "members")
    blobs.free_shuffles(spark)
    if members.isEmpty():
        return None
    least = threshold - SLACK
    ids = members.select("id").distinct()
    # one text and one signature for each item: of its least doc_id
    first = sketches.groupBy("id").agg(F.min_by(F.struct("row", "sig"), F.struct("doc_id", "row")).alias("x"))
    first = stored(first.join(ids, "id", "left_semi").select("id", "x.row", "x.sig"), "items")
    sigs = first.select("id", "sig")
    # texts are joined by sorting at every size: what they are joined with has no bound
    texts = stored(docs.join(first.select("id", "row").hint("merge"), "row").select("id", "text").dropDuplicates(["id"]), "texts")
    blobs.free_shuffles(spark)

    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    close = stored(agreeing(pairs, sigs, least), "candidates")
    good = stored(starred(close, texts, threshold), "similar")
    blobs.free_shuffles(spark)
    labels = None if good.isEmpty() else components(good)

    def rooted(rows: DataFrame, known: DataFrame | None, name: str = "root") -> DataFrame:
        return rows.withColumn(name, F.col("id")) if known is None else rows.join(known.withColumnRenamed("root", name), "id", "left").withColumn(name, F.coalesce(name, "id"))

    # items that a hub has shown to be of one family needn't meet to show it
    alike, families = close, None if close.isEmpty() else components(close)
    made = [members, first, texts, close, good]
    bands = members.select("key", "id").distinct()
    keys = stored(apart(rooted(bands, families), 3), "mixed")
    for some in (F.col("n") <= large, F.col("n") > large):
        own = keys.where(some)
        if own.isEmpty():
            continue
        if alike is not close:  # families have grown since
            own = stored(apart(rooted(bands.join(own.select("key"), "key"), families), 3), "mixed")
            made.append(own)
        meeting = rooted(bands.join(own, "key"), families).join(sigs, "id")
        near = stored(blocks(meeting, "sig").mapInArrow(lean(block_rows(by_signature, least, False)), "a long, b long").distinct(), "families")
        blobs.free_shuffles(spark)
        made.append(near)
        if not near.isEmpty():
            alike = alike.unionByName(near)
            families = components(alike)
    items = rooted(rooted(ids, labels), families, "key")
    again = stored(apart(items, 2), "mixed")
    made += [keys, again]
    if not again.isEmpty():
        rows = items.join(again, "key").join(texts, "id")
        more = stored(blocks(rows, "text").mapInArrow(lean(block_rows(by_overlap, threshold, True)), "a long, b long").distinct(), "similar")
        made.append(more)
        blobs.free_shuffles(spark)
        if not more.isEmpty():
            labels = components(good.unionByName(more))
    forget(*made)
    return labels


def plain(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def classes(docs: DataFrame, threshold: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """doc_id, row, root, class_id (the class's least doc_id), class_size, for every row of docs.

    ``row`` is xxhash64(doc_id, text); ``root`` names the class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = plain(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(sketch_rows(iter([b.select(["doc_id", "row", "text"])])))
            row, at = b.column(1), 0
            for m in made:
                yield pa.RecordBatch.from_arrays([m.column(0), row.slice(at, m.num_rows), *m.columns[1:]], names=["doc_id", "row", "id", "sig", "bands"])
                at += m.num_rows

    sketches = stored(rows.mapInArrow(lean(sketch), "doc_id long, row long, id long, sig binary, bands binary"), "sketches")
    labels = links(rows.select("row", "text"), sketches, threshold, large)
    own = sketches.select("doc_id", "row", "id")
    own = own.join(labels, "id", "left").select("doc_id", "row", F.coalesce("root", "id").alias("root")) if labels is not None else own.withColumnRenamed("id", "root")
    own = stored(own, "roots")
    forget(sketches)
    # a table of its own, so that the join below is one of two plain shuffles, of which a large class can be split
    least = stored(own.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return own.join(least, "root").select("doc_id", "row", "root", "class_id", "class_size")


def first_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs that have their class's least doc_id; of equal doc_ids the one with the least hash."""
    found = classes(docs, threshold)
    kept = found.where("doc_id <=> class_id").groupBy("class_id", "doc_id", "root").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    kept = stored(kept.select("row", "n"), "kept")
    # the row is held in one column, so that its names cannot clash with those made here
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"))
    out = marked.join(kept.select("row").distinct().hint("merge"), "row", "left_semi")
    if not kept.where("n > 1").isEmpty():  # rows alike in doc_id and text
        out = out.dropDuplicates(["row"])
    return out.select("doc.*")
