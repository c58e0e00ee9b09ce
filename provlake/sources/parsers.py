"""Parsers. What is regular stays in Spark expressions; BibTeX nesting and TeX positions are Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import CITE, citation_keys, lines_of, or_none, sha256, squeezed, strip
from provlake.session import checkpointed

# --- BibTeX ----------------------------------------------------------------------------------------

ENTRY_START = re.compile(r"@(\w+)\s*\{", re.ASCII)
NAME = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one before ``at``; the end of the text if none does."""
    depth = 1
    for m in re.finditer(r"\\.|[{}]", text[at:], re.DOTALL):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return at + m.start()
    return len(text)


def value_at(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """A field's value, whose parts # joins: braces, quotes, or a bare word that may be a macro."""
    parts = []
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "{":
            end = closing(text, at + 1)
            parts.append(text[at + 1 : end])
            at = end + 1
        elif at < len(text) and text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth or text[end - 1] == "\\"):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            parts.append(text[at + 1 : end])
            at = end + 1
        else:
            m = re.compile(r"[^,#}\s]*").match(text, at)
            parts.append(m[0])
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            break
        at = m.end()
    parts = [macros.get(p.strip().lower(), p) for p in parts]
    return re.sub(r"\s+", " ", "".join(parts)).strip(), at


def bibtex_entries(text: str) -> list[dict]:
    """Entries in order: key, type, fields, raw, start, end, error. Comments and preambles are left out."""
    out: list[dict] = []
    macros: dict[str, str] = {}
    at = 0
    while m := ENTRY_START.search(text, at):
        kind, end = m[1].lower(), closing(text, m.end())
        body, at = text[m.end() : end], end + 1
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            if n := NAME.match(body):
                macros[n[1].lower()] = value_at(body, n.end(), macros)[0]
            continue
        key, comma, rest = body.partition(",")
        fields, error = {}, None if comma and end < len(text) else "entry is not closed" if end >= len(text) else "entry has no key"
        place = 0
        while n := NAME.match(rest, place):
            value, place = value_at(rest, n.end(), macros)
            fields[n[1].lower()] = value
            comma_ = re.compile(r"[^,]*,").match(rest, place)
            if not comma_:
                break
            place = comma_.end()
        out.append({"citation_key": key.strip() or None, "entry_type": kind, "fields": list(fields.items()), "raw_text": text[m.start() : at], "start": m.start(), "end": min(at, len(text)), "error": error})
    return out


ENTRY = "path string, ord int, citation_key string, entry_type string, fields map<string,string>, raw_text string, start int, end int, error string"


def bib_entries(files: DataFrame) -> DataFrame:
    """Entries of BibTeX files (path, text). A malformed entry has an error and doesn't stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "ord": i, **e} for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, e in enumerate(bibtex_entries(t or ""))]
            kinds = [("path", pa.string()), ("ord", pa.int32()), ("citation_key", pa.string()), ("entry_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("raw_text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("error", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds], names=[n for n, _ in kinds])

    return files.select("path", "text").mapInArrow(run, ENTRY)


def normal_fields(fields: Column) -> Column:
    """A map of fields with doi, pages, url and publisher in their usual form."""
    from provlake.functions.text import doi, pages

    names = F.create_map(*(F.lit(x) for kv in K.PUBLISHERS.items() for x in kv))

    def value(k: Column, v: Column) -> Column:
        house = F.trim(F.regexp_replace(v, r"\s+", " "))
        return F.when(k == "doi", doi(v)).when(k == "pages", pages(v)).when(k == "url", F.trim(v)).when(k == "publisher", F.coalesce(F.try_element_at(names, F.lower(house)), house)).otherwise(v)

    return F.transform_values(fields, value)


def bib_table(files: DataFrame, key: str = "citation_key") -> DataFrame:
    """Bibliographies as they count: fields in their usual form, of entries of one key the last; malformed ones are left out."""
    rows = bib_entries(files).where("error is null and citation_key is not null").withColumn("fields", normal_fields(F.col("fields")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("path", key).orderBy(F.desc("ord")))).where("_r = 1").drop("_r")


def rekeyed(raw: Column, key: Column) -> Column:
    """An entry's text with another key."""
    head = F.regexp_extract(raw, r"^(\s*@\w+\s*\{)", 1)
    return F.concat(head, key, F.regexp_replace(raw, r"^\s*@\w+\s*\{[^,]*", ""))


#: A whole entry: kind, key, body.
WHOLE = r"(?s)@\s*(\w+)\s*\{\s*([^,\s]+)\s*,(.*)\}\s*$"


def bib_spans(files: DataFrame) -> DataFrame:
    """path, ord, start, end, text, citation_key, preface: a bibliography cut wherever an entry begins.

    What can't be read as an entry, and macros, comments and preambles, have no key. preface is what stands before the
    first entry. Offsets are summed over rows, so a file may hold any number of entries.
    """
    begins = r"@\s*\w+\s*\{"
    t = files.select("path", F.posexplode(F.split("text", rf"(?={begins})")).alias("pos", "part"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"end": F.sum(F.length("part")).over(w).cast("int"), "preface": F.first(F.when((F.col("pos") == 0) & ~F.regexp_like("part", F.lit(rf"^{begins}")), F.col("part"))).over(Window.partitionBy("path").orderBy("pos"))})
    t = t.where(F.regexp_like("part", F.lit(rf"^{begins}"))).withColumn("text", strip(F.col("part")))
    kind = F.lower(F.regexp_extract("text", r"^@\s*(\w+)", 1))
    key = F.when(~kind.isin("string", "comment", "preamble"), or_none(F.regexp_extract("text", WHOLE, 2)))
    first = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return t.select("path", first.alias("ord"), (F.col("end") - F.length("part")).alias("start"), "end", "text", key.alias("citation_key"), "preface")


def bibtex_record(raw: Column, kind: str = "official_export", key: Column | None = None) -> Column:
    """struct of an entry's text with its two checksums; null if it is no entry."""
    own = F.regexp_extract(strip(raw), WHOLE, 2)
    record = F.struct(
        F.lower(F.regexp_extract(strip(raw), WHOLE, 1)).alias("entry_type"), (own if key is None else key).alias("citation_key"), F.lit(kind).alias("source_kind"),
        raw.alias("raw_text"), sha256(raw).alias("raw_sha256"), sha256(F.concat(strip(raw), F.lit("\n"))).alias("normalized_sha256"),
    )
    return F.when(own != "", record)


# --- TeX -------------------------------------------------------------------------------------------

HEADING = r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{[^{}]*\}"
DEPTH = 20


def cited_keys(files: DataFrame) -> DataFrame:
    """path, citation_key: distinct keys that TeX files cite, in comments too."""
    keys = F.explode(F.regexp_extract_all("text", F.lit(CITE), F.lit(1)))
    return files.select("path", keys.alias("k")).select("path", F.explode(citation_keys(F.col("k"))).alias("citation_key")).distinct()


def included(files: DataFrame) -> DataFrame:
    """path, ord, target: what TeX files include, comments left out; .tex is added where there is no suffix."""
    plain = F.regexp_replace("text", r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")
    t = files.select("path", F.posexplode(F.regexp_extract_all(plain, F.lit(r"\\(?:input|include)\s*\{([^{}]+)\}"), F.lit(1))).alias("ord", "target"))
    t = t.withColumn("target", strip(F.col("target"))).where("target <> ''")
    return t.withColumn("target", F.when(F.regexp_like("target", F.lit(r"[^/]\.[^./]+$")), F.col("target")).otherwise(F.concat("target", F.lit(".tex"))))


def closure(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root, path, depth: what is reached from the roots, each path at its least depth. edges: source, target.

    One join a level, from the paths that were new on the level before; paths that were reached are never gone through
    again, so cycles end and the work is that of the edges, however many ways lead along them.
    """
    edges = edges.select("source", "target").distinct()
    level = checkpointed(roots.select(F.col("path").alias("root"), "path", F.lit(0).alias("depth")).distinct())
    reached = level
    for d in range(1, depth + 1):
        step = level.join(edges, level["path"] == edges["source"]).select("root", F.col("target").alias("path"), F.lit(d).alias("depth")).distinct()
        level = checkpointed(step.join(reached.select("root", "path"), ["root", "path"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def tex_documents(files: DataFrame, roots: DataFrame, submission: bool = False, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(sources, issues) of manuscripts: project, root, ord, path, depth, and project, root, ord, code, severity, evidence.

    files: project, path, text; roots: project, path. Files stand in the order in which they are read, each once; what a
    file includes is sought from the root's folder. Cycles, files that are missing and includes beyond ``depth`` are
    issues. Only names meet in one task, those of one manuscript's files.
    """
    severity = "blocking" if submission else "warning"
    named = files.select(F.to_json(F.struct("project", "path")).alias("path"), "text")
    targets = included(named).withColumn("path", F.from_json("path", "project string, path string"))
    targets = targets.select("path.project", "path.path", "ord", "target")
    rows = files.select("project", "path").join(targets, ["project", "path"], "left").join(roots.select("project", F.col("path").alias("root")).distinct(), "project")

    def walk(project: str, top: str, held: list[dict]) -> list[tuple]:
        from posixpath import dirname, join, normpath

        base = dirname(top)
        ways: dict[str, list[str]] = {}
        there = {normpath(x["path"]) for x in held}
        for p, _, t in sorted((x["path"], x["ord"], x["target"]) for x in held if x["target"] is not None):
            ways.setdefault(normpath(p), []).append(join(base, t))
        out: list[tuple] = []
        done: set[str] = set()
        trail: list[tuple[str, Iterator[str]]] = []

        def enter(path: str) -> None:
            p, fault = normpath(path), None
            shown = path.removeprefix(base + "/") if base else path
            if len(trail) > depth:
                fault = ("TEX_INCLUDE_DEPTH_EXCEEDED", [shown, str(depth)])
            elif any(p == q for q, _ in trail):
                fault = ("TEX_INCLUDE_CYCLE", [shown])
            elif p in done:
                return
            elif p not in there:
                fault = ("TEX_INCLUDE_MISSING", [shown])
            out.append((project, top, len(out), path, len(trail), *(fault or (None, []))))
            if fault is None:
                trail.append((p, iter(ways.get(p, []))))

        enter(top)
        while trail:
            p, rest = trail[-1]
            following = next(rest, None)
            if following is None:
                done.add(p)
                trail.pop()
            else:
                enter(following)
        return out

    kinds = [("project", pa.string()), ("root", pa.string()), ("ord", pa.int32()), ("path", pa.string()), ("depth", pa.int32()), ("code", pa.string()), ("evidence", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in walk(*row)]
            cols = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    # many manuscripts a batch: a call for each costs more than the walk
    names = rows.groupBy("project", "root").agg(F.collect_list(F.struct("path", "ord", "target")).alias("held"))
    walked = names.mapInArrow(run, "project string, root string, ord int, path string, depth int, code string, evidence array<string>")
    sources = walked.where("code is null").select("project", "root", "ord", "path", "depth")
    return sources, walked.where("code is not null").select("project", "root", "ord", "code", F.lit(severity).alias("severity"), "evidence")


def plain_tex(text: str) -> str:
    """Without comments, headings and emphasis."""
    text = re.sub(HEADING, " ", re.sub("%.*", "", text))
    return re.sub(r"\s+", " ", re.sub(r"\\(?:textbf|emph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)).strip()


def tex_paragraphs(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """(paragraph in one line, where its lines begin in it, their numbers); blank lines and headings end one."""
    held: list[tuple[int, str]] = []
    for n, line in enumerate([*text.splitlines(), ""], 1):
        line = line.partition("%")[0].strip()
        rest = re.sub(HEADING, " ", line).strip()
        if (not line or rest != line) and held:
            lengths = [len(x) + 1 for _, x in held]
            yield " ".join(x for _, x in held), [sum(lengths[:i]) for i in range(len(held))], [i for i, _ in held]
            held = []
        if rest:
            held.append((n, rest))


def without_citations(text: str) -> str:
    """A claim's words: no citations, no conjunction and signs before, no signs after."""
    text = re.sub(r"(?i)^[\s,;:.-]*(?:and|while|whereas|but|however|also)\b[\s,;:.-]*", "", re.sub(CITE, " ", text))
    return re.sub(r"\s+", " ", re.sub(r"[\s,;:.-]+$", "", text)).strip()


def clause(text: str) -> str:
    """What follows the last sign that ends a clause; a late comma, or one before the end of a list, ends none."""
    comma = text.rfind(",")
    if len(text) - comma <= 24 or re.match(r"(?:and|or)\b", text[comma + 1 :].strip().lower()):
        comma = -1
    return text[max(comma, *(text.rfind(c) for c in ".;:?!")) + 1 :]


def stubs_of(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, sentence, claim, key) of each key that a citation names, keys of one citation in order."""
    for paragraph, starts, numbers in tex_paragraphs(text):
        ends = [m.span() for m in re.finditer(r"(?<=[.!?])\s+", paragraph)] + [(len(paragraph), len(paragraph))]
        begin = 0
        for end, following in ends:
            sentence, at, begin = paragraph[begin:end], begin, following
            if (cite := sentence.find("\\cite")) < 0:
                continue
            line = numbers[bisect_right(starts, at + cite) - 1]
            sentence = plain_tex(sentence)
            before = 0
            for m in re.finditer(CITE, sentence):
                claim = without_citations(clause(sentence[before : m.start()]))
                before = m.end()
                if len(claim.split()) < 3:
                    claim = without_citations(sentence)
                for key in sorted(k for k in re.split(r"[,;\s]+", m[1]) if k):
                    yield line, sentence, claim, key


def claim_stubs(files: DataFrame) -> DataFrame:
    """path, ord, line, sentence, claim_text, citation_key: one row for each key of each citation.

    A claim is what stands before its citation, from the citation or the end of a clause before on; the whole sentence
    where that is under three words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *s) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, s in enumerate(stubs_of(t or ""))]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "ord", "line", "sentence", "claim_text", "citation_key"])

    return files.select("path", "text").mapInArrow(run, "path string, ord int, line int, sentence string, claim_text string, citation_key string")


def claim_importance(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.exists(F.array(*map(F.lit, K.WEIGHTY_TERMS)), lambda t: F.contains(low, t)), "important").otherwise("normal")


def claim_type(text: Column) -> Column:
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda t: F.contains(low, t))
    return F.when(has(K.RESULT_TERMS), "benchmark_or_result").when(has(K.METHOD_TERMS), "method_description").otherwise("related_work")


def new_claims(stubs: DataFrame, existing: DataFrame, by: str = "project", first: int = 1) -> DataFrame:
    """Rows of the claims table for stubs that it lacks, numbered from ``first`` in order of files.

    stubs: project, file_ord, and the columns of ``claim_stubs``; existing: project, claim_text, citation_key. A claim that
    an earlier file has too is left out; repeats within a file stay.
    """
    known = existing.select(by, F.coalesce("claim_text", F.lit("")).alias("claim_text"), F.coalesce("citation_key", F.lit("")).alias("citation_key")).distinct()
    least = stubs.groupBy(by, "claim_text", "citation_key").agg(F.min("file_ord").alias("file_ord"))
    new = stubs.join(known, [by, "claim_text", "citation_key"], "left_anti").join(least, [by, "claim_text", "citation_key", "file_ord"], "left_semi")
    n = F.row_number().over(Window.partitionBy(by).orderBy("file_ord", "ord")) + (first - 1)
    none = F.lit("")
    place = F.when(F.col("path") == "", F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise(F.concat("path", F.lit(":line "), F.col("line").cast("string")))
    return new.select(
        by, F.concat(F.lit("claim-"), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))).alias("claim_id"), place.alias("manuscript_location"), F.col("path").alias("source_file"), "claim_text", "citation_key",
        none.alias("source_location"), none.alias("quote_or_evidence"), none.alias("evidence_kind"), F.lit("claim_unchecked").alias("status"), none.alias("notes"),
        claim_type(F.col("claim_text")).alias("claim_type"), claim_importance(F.col("claim_text")).alias("importance"),
    )


def claimed_keys(claims: DataFrame) -> DataFrame:
    """citation_key, ord, pos: distinct keys that claims cite, and where each is first seen. claims: ord, citation_key."""
    keys = claims.select("ord", F.posexplode(citation_keys(F.col("citation_key"))).alias("pos", "citation_key"))
    return keys.groupBy("citation_key").agg(F.min(F.struct("ord", "pos")).alias("x")).select("citation_key", "x.ord", "x.pos")


def recommended_sources(venue: Column, url: Column, doi: Column, arxiv: Column) -> Column:
    """Where to look a record up, in order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(venue, F.lit("")), F.coalesce(url, F.lit(""))))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    own = F.filter(F.array(F.when(has(doi), "crossref"), *(F.when(F.exists(F.array(*map(F.lit, h)), lambda x: F.contains(text, x)), s) for s, h in K.VENUE_HINTS)), lambda x: x.isNotNull())
    own = F.when(has(arxiv) | (F.size(own) == 0), F.array_append(own, F.lit("arxiv"))).otherwise(own)
    return F.array_distinct(F.concat(own, F.array(F.lit("openalex"), F.lit("semantic_scholar"))))


def blocks(texts: DataFrame, column: str = "text", every: bool = False) -> DataFrame:
    """path, block_ord, label, text: paragraphs, or else lines, of each marked page; without marks the paragraphs.

    every: each text has a row of block_ord -1 too, without label and text, so that none is left out.
    """
    mark = r"(?imdU)^\[page\s+([^\]]+)\]\s*$"
    text = lambda x: x != ""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """use(value), with value made once; named again within a function of elements it would be made for each of them."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def paragraphs(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, r"(?U)\n\s*\n"), strip), text)

    def numbered(parts: Column, name: Column) -> Column:
        many = F.size(parts) > 1
        return F.transform(parts, lambda x, i: F.struct(F.concat(name, F.when(many, F.concat(F.lit(" paragraph "), (i + 1).cast("string"))).otherwise("")).alias("label"), squeezed(x).alias("text")))

    def page(x: Column) -> Column:
        lines = F.filter(F.transform(lines_of(x["content"]), strip), text)
        parts = once(paragraphs(x["content"]), lambda p: F.when(F.size(p) > 1, p).otherwise(lines))
        return once(F.concat(F.lit("page "), strip(x["name"])), lambda name: once(parts, lambda p: numbered(p, name)))

    own = r"(?isU)^\[page\s+(\d+)\]\s*(.*)"

    def plain(x: Column, i: Column) -> Column:
        number = F.regexp_extract(x, own, 1)
        label = F.when(number != "", F.concat(F.lit("page "), number)).otherwise(F.concat(F.lit("paragraph "), (i + 1).cast("string")))
        return F.struct(label.alias("label"), squeezed(F.when(number != "", F.regexp_extract(x, own, 2)).otherwise(x)).alias("text"))

    def cut(t: Column, names: Column) -> Column:
        pages = F.arrays_zip(names.alias("name"), F.slice(F.split(t, mark), 2, F.greatest(F.size(names), F.lit(1))).alias("content"))
        return F.when(F.size(names) > 0, F.flatten(F.transform(pages, page))).otherwise(F.transform(paragraphs(t), plain))

    out = once(F.col(column), lambda t: once(F.regexp_extract_all(t, F.lit(mark), F.lit(1)), lambda names: cut(t, names)))
    if every:
        none = F.lit(None).cast("string")
        out = F.concat(F.array(F.struct(none.alias("label"), none.alias("text"))), F.coalesce(out, F.array().cast("array<struct<label:string,text:string>>")))
    return texts.select("path", F.posexplode(out).alias("block_ord", "b")).select("path", (F.col("block_ord") - 1 if every else F.col("block_ord")).alias("block_ord"), "b.label", "b.text")
