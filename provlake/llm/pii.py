"""Personal data: base rules, high-recall generators and boosted trees over the spans they propose.

DataFrame functions only: spans come from ``regexp_extract_all`` and ``split`` with one pattern, whose piece
lengths give each match's place; features are arithmetic on the candidates; the trees become nested CASE
expressions. Patterns use possessive repeats and ``\\G``, so that they match as their plain forms do, but in
time proportional to the text and without recursion.

Base spans (email, ip, card, phone) always stay. Generators propose more: addresses and numbers written with blanks or
words for the signs, phone numbers without a plus and of other countries' forms, card numbers with other signs between the
digits, and secrets (keys and passwords), which have no base rule. Whether a proposal is taken is learnt from marks: of
the four kinds the mark is that a base span of the kind overlaps it, of secrets that a word such as ``token`` with a sign of
assignment stands before it, or that it begins as known keys do. That only says that the mark is there, so features leave
out all that tells it (signs or words, plus and country code, brackets, separators, and what stands before a secret), and a
proposal without the mark may be as good as one with it: where proposals look most like marked ones, the share with a mark
is taken as the share of good ones that have it, and precision is counted against it. Kinds of which under ``LEAST_MARKED``
have it there get no more spans. Shares are counted with ``DOUBT`` more proposals without the mark, so that little evidence
weighs little, at every size by the same rule.
Features are small integers, so the training set is a table of counts of feature combinations, bounded by the
product of their ranges (``COMBINATIONS``) however many documents there are; it covers all documents. Trees are
fitted on documents of one hashed half, thresholds are set on the other for ``PRECISION``.

Edge cases: null text counts as empty, which has no spans; base_sha256 of no spans is that of the empty string;
repeated rows and a null doc_id are kept; an empty table gives no rows; other columns are ignored. Offsets are
code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import stored
from provlake.llm.quality_trees import Forest, boost

KINDS = ("email", "ip", "card", "phone")
#: With those that only generators propose.
ALL_KINDS = (*KINDS, "secret")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single blanks or hyphens between them, of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: What generators propose, by the kind it would be.
#: How known keys begin.
KEYS = "(?:AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|xox[abprs]-|AIza|eyJ)"
DOT = r" ?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?"
PROPOSED = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|\(at\)|\[at\]) ?{LABEL}++(?: ?(?:\.|\(dot\)|\[dot\]) ?{LABEL}++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{DOT}[0-9]{{1,3}}+){{3}}(?!{DOT}?[0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ._/-]{1,3})[0-9](?:[ ._/-]{0,3}[0-9]){11,18}+(?![ ._/-]{0,3}[0-9])",
    "phone": r"(?<![0-9])(?<![0-9][ .-])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ .-]?[0-9]{2,5}){2,4}(?![0-9])",
    "secret": rf"(?<![A-Za-z0-9+/_-])(?:(?={KEYS})|(?=[0-9+/_-]{{0,64}}[A-Za-z])(?=[A-Za-z+/_-]{{0,64}}[0-9]))[A-Za-z0-9+/_-]{{16,}}+={{0,2}}+(?![A-Za-z0-9+/_=-])",
}
#: Plus and country code of a proposed phone number.
CODE = r"^(?:\+|00)[0-9]{1,3}[ .-]?(?=\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$)"
#: The mark of a secret: what ends before it, or how it begins.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?$"
#: Words before a span that speak for a kind.
CONTEXT = {
    1: r"(?i)(?:phone|tel|call|fax|mobile|cell)[^A-Za-z0-9]{0,4}$",
    2: r"(?i)(?:card|visa|credit|account|iban)[^A-Za-z0-9]{0,4}$",
    3: r"(?i)(?:mail|contact|write|reach)[^A-Za-z0-9]{0,4}$",
}
#: Feature: number of its values.
FEATURES = {"kind": 5, "digits": 6, "groups": 5, "before": 4, "after": 4, "context": 4, "tail": 2}
COMBINATIONS = int(np.prod(list(FEATURES.values())))
TREES, DEPTH, RATE = 30, 3, 0.3
PRECISION = 0.95
DOUBT = 2.0
LEAST_MARKED = 0.2
#: Blocks that a fold goes through at each level, and its levels above the elements.
WIDTH, LEVELS = 64, 2
#: Characters of a piece of text, where places in it are looked up.
PIECE = 256


def fold(xs: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str, finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """What step makes of each element, in order, with a state that runs along. finish gets the last state and all that was made.

    ``aggregate`` copies all that its accumulator holds at each element, so what is made gathers in blocks of blocks:
    each level goes through ``WIDTH`` blocks of the level below and holds what they have made only. An element is copied
    about WIDTH / 2 times a level, instead of once for each that follows it.
    """
    none, names = F.array().cast(f"array<{kind}>"), list(state)

    def held(state: dict[str, Column], made: Column) -> Column:
        return F.struct(*(state[n].alias(n) for n in names), made.alias("_made"))

    def level(k: int, xs: Column, state: dict[str, Column], end: Callable[[Column], Column]) -> Column:
        if k == 0:

            def one(acc: Column, x: Column) -> Column:
                new, made = step(acc, x)
                return held(new, F.concat(acc["_made"], F.array(made)))

            return F.aggregate(xs, held(state, none), one, end)
        size = WIDTH**k
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / size).cast("int")), lambda i: F.slice(xs, i * size + 1, F.lit(size)))

        def below(acc: Column, block: Column) -> Column:
            return level(k - 1, block, {n: acc[n] for n in names}, lambda a: held({n: a[n] for n in names}, F.concat(acc["_made"], a["_made"])))

        return F.aggregate(blocks, held(state, none), below, end)

    # an array of one element holds xs, so that it is made once and not for each block
    return F.get(F.transform(F.array(xs), lambda bound: level(LEVELS, bound, state, lambda a: a["_made"] if finish is None else finish(a, a["_made"]))), F.lit(0))


SPAN = "struct<s:int,e:int,m:string>"


def places(text: Column, pattern: str) -> Column:
    """array of struct(s, e, m): where the pattern matches, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a match and what stands before it; the last piece has no match after it
    pairs = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("b"))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        s = acc["at"] + F.length(x["b"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return {"at": e}, F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))

    return F.filter(fold(pairs, {"at": F.lit(0)}, step, SPAN), lambda x: x["m"].isNotNull())


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        return F.call_function("luhn_check", digits_of(m))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    if kind == "dotted":
        return F.regexp_like(F.regexp_replace(m, "[^0-9]+", "."), F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    return F.lit(True)


#: What every match of a pattern of the kind has; texts without it are not searched. Digits may stand apart.
NEEDS = {"email": "[@(\\[]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9+/_-]{16}"}


def spotted(text: Column, kind: str, pattern: str) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.regexp_like(text, F.lit(NEEDS[kind])), places(text, pattern)).otherwise(none)


def cut_up(text: Column) -> Column:
    """A text in pieces of PIECE characters, so that a place in it is reached without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))


def part(pieces: Column, at: Column, length: Column) -> Column:
    """``length`` characters from place ``at`` on, of a text in pieces; in time proportional to length and PIECE."""
    first = F.floor(at / PIECE).cast("int")
    last = F.floor((at + length - 1) / PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(some, at - first * PIECE + 1, length)


def around(pieces: Column, s: Column, e: Column) -> tuple[Column, Column, Column]:
    """24 characters before a span, the one before it, the one after it."""
    left = part(pieces, F.greatest(s - 24, F.lit(0)), F.least(s, F.lit(24)))
    return left, F.right(left, F.lit(1)), part(pieces, e, F.lit(1))


def char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.isin(" ", "\n", "\t"), 1).when(F.regexp_like(c, F.lit("[A-Za-z0-9]")), 2).otherwise(3)


def featured(pieces: Column, kind: str, x: Column) -> Column:
    """struct(kind number, s, e, FEATURES...) of one proposal."""
    m = F.regexp_replace(x["m"], CODE, "") if kind == "phone" else x["m"]
    d = digits_of(m)
    n = F.length(d)
    left, before, after = around(pieces, x["s"], x["e"])
    context = F.lit(0)
    for code, pattern in CONTEXT.items():
        context = F.when(F.regexp_like(left, F.lit(pattern)), code).otherwise(context)
    values = {
        "kind": F.lit(ALL_KINDS.index(kind)),
        "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5),
        "groups": F.least(F.size(F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " ")) - 1, F.lit(4)),
        "before": char_class(before) if kind != "secret" else F.lit(0),
        "after": char_class(after) if kind != "secret" else F.lit(0),
        "context": context,
        "tail": F.when(F.regexp_like(m, F.lit("(?:^|[^A-Za-z0-9-])[a-z]{2,4}$")), 1).otherwise(0),
    }
    mark = (F.regexp_like(left, F.lit(ASSIGNED)) | F.regexp_like(x["m"], F.lit("^" + KEYS))) if kind == "secret" else F.lit(False)
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), *(v.cast("int").alias(k) for k, v in values.items()), mark.cast("int").alias("mark"))


def only(kind: str) -> Callable[[Column], Column]:
    return lambda x: valid(kind, x["m"])


def numbered(i: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))


def proposal(pieces: Column, kind: str) -> Callable[[Column], Column]:
    return lambda x: featured(pieces, kind, x)


def of_kind(i: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == i


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """rows with base (array of s, kind number, e), proposals (array of featured structs) and _pieces (the text's)."""
    rows = rows.withColumn("_pieces", cut_up(text))
    base = []
    for i, kind in enumerate(KINDS):
        good = F.filter(spotted(text, kind, BASE[kind]), only(kind))
        base.append(F.transform(good, numbered(i)))
    more = []
    for kind, p in PROPOSED.items():
        some = spotted(text, kind, p)
        # a check digit, a number of digits, and numbers up to 255 are no marks that good ones may lack
        rule = {"card": "card", "phone": "phone", "ip": "dotted"}.get(kind)
        some = F.filter(some, only(rule)) if rule else some
        more.append(F.transform(some, proposal(F.col("_pieces"), kind)))
    rows = rows.withColumns({"base": F.array_sort(F.concat(*base)), "_more": F.concat(*more)})
    return rows.withColumn("proposals", F.when(F.size("_more") == 0, F.array().cast(f"array<{PROPOSAL}>")).otherwise(met(F.col("base"), F.col("_more")))).drop("_more")


PROPOSAL = "struct<s:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ",mark:int,own:boolean,any:boolean>"
ITEM = "struct<s:int,p:int,k:int,e:int,x:struct<s:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ",mark:int>,own:boolean,any:boolean>"


def met(base: Column, proposals: Column) -> Column:
    """The proposals with own and any: whether a base span of their kind, or of any, overlaps them.

    Both lists are run through in order of their starts, once forwards for base spans that begin before a proposal ends
    after them, once backwards for those that begin within it.
    """
    kinds = range(len(KINDS))
    nothing = F.lit(None).cast("struct<s:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ",mark:int>")
    one = F.transform(base, lambda y: F.struct(y["s"].alias("s"), F.lit(0).alias("p"), y["k"].alias("k"), y["e"].alias("e"), nothing.alias("x")))
    two = F.transform(proposals, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("p"), x["kind"].alias("k"), x["e"].alias("e"), x.alias("x")))

    def of_own(acc: Column, k: Column, other: Column) -> Column:
        out = other
        for i in kinds:
            out = F.when(k == i, acc[f"k{i}"]).otherwise(out)
        return out

    def forwards(acc: Column, i: Column) -> tuple[dict[str, Column], Column]:
        new = {f"k{j}": F.when((i["p"] == 0) & (i["k"] == j), F.greatest(acc[f"k{j}"], i["e"])).otherwise(acc[f"k{j}"]) for j in kinds}
        own = i["s"] < of_own(acc, i["k"], F.lit(0))
        return new, F.struct(*(i[f].alias(f) for f in ("s", "p", "k", "e", "x")), own.alias("own"), (i["s"] < F.greatest(*(acc[f"k{j}"] for j in kinds))).alias("any"))

    far = F.lit(2**31 - 1)

    def backwards(acc: Column, i: Column) -> tuple[dict[str, Column], Column]:
        new = {f"k{j}": F.when((i["p"] == 0) & (i["k"] == j), i["s"]).otherwise(acc[f"k{j}"]) for j in kinds}
        own = i["own"] | (of_own(acc, i["k"], far) < i["e"])
        return new, F.struct(*(i[f].alias(f) for f in ("s", "p", "k", "e", "x")), own.alias("own"), (i["any"] | (F.least(*(acc[f"k{j}"] for j in kinds)) < i["e"])).alias("any"))

    there = fold(F.array_sort(F.concat(one, two)), {f"k{j}": F.lit(0) for j in kinds}, forwards, ITEM)
    back = fold(F.reverse(there), {f"k{j}": far for j in kinds}, backwards, ITEM)
    named = ["s", "e", *FEATURES, "mark"]
    return F.transform(F.filter(F.reverse(back), lambda i: i["p"] == 1), lambda i: F.struct(*(i["x"][f].alias(f) for f in named), i["own"].alias("own"), i["any"].alias("any")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, proposals."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_spans(rows, F.col("text")).drop("text", "_pieces")


def counted(found: DataFrame) -> list[tuple]:
    """(half, label, FEATURES..., rows) of all proposals; at most 4 x COMBINATIONS rows reach the driver."""
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    label = F.transform("proposals", lambda x: F.struct(x.alias("x"), F.greatest(x["own"].cast("int"), x["mark"]).alias("label")))
    rows = found.where(F.size("proposals") > 0).select(half, F.explode(label).alias("p"))
    keys = [F.col("half"), F.col("p.label").alias("label"), *(F.col(f"p.x.{f}").alias(f) for f in FEATURES)]
    return [tuple(r) for r in rows.select(*keys).groupBy("half", "label", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()]


def fit(counts: list[tuple]) -> tuple[Forest, dict[int, float]]:
    """The trees, and for each kind the score from which proposals are taken."""
    counts = sorted(counts)
    x = np.array([c[2:-1] for c in counts], float).reshape(-1, len(FEATURES))
    y = np.array([c[1] for c in counts], float)
    w = np.array([c[-1] for c in counts], float)
    half = np.array([c[0] for c in counts])
    own = half == 0
    forest = boost(x[own], y[own], np.zeros(len(FEATURES)), TREES, DEPTH, RATE, weight=w[own])
    score = forest.score(x)
    cuts = {}
    for k in range(len(ALL_KINDS)):
        there = (half == 1) & (x[:, 0] == k)
        cuts[k] = 2.0
        if not there.any():
            continue
        order = np.argsort(-score[there], kind="stable")
        s, good, n = score[there][order], np.cumsum((y * w)[there][order]), np.cumsum(w[there][order])
        ends = np.r_[s[1:] != s[:-1], True]
        share = good / (n + DOUBT)
        marked = share[ends].max()
        fine = ends & (share >= PRECISION * marked) & (s >= 0.5 * marked)
        if marked >= LEAST_MARKED and fine.any():
            cuts[k] = float(s[np.flatnonzero(fine)[-1]]) - 1e-9
    return forest, cuts


def tree_expression(forest: Forest, x: Column) -> Column:
    """The forest's sum as nested CASE expressions over a proposal's features."""
    names = list(FEATURES)

    def node(i: int) -> Column:
        if forest.left[i] == i:
            return F.lit(float(forest.value[i]))
        return F.when(x[names[int(forest.feature[i])]] <= F.lit(float(forest.threshold[i])), node(int(forest.left[i]))).otherwise(node(int(forest.right[i])))

    total = F.lit(float(forest.base))
    for root in forest.roots:
        total = total + node(int(root))
    return 1 / (1 + F.exp(-total))


def chosen(found: DataFrame, forest: Forest, cuts: dict[int, float]) -> DataFrame:
    """found with spans: base ones and the proposals taken, as struct(s, k, e) by start, then kind, then end."""
    cut = F.lit(2.0)
    taken = F.transform("proposals", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("k"), tree_expression(forest, x).alias("p"), x["any"].alias("any")))

    def passes(c: Column) -> Column:
        need = cut
        for k, v in cuts.items():
            need = F.when(c["k"] == k, F.lit(v)).otherwise(need)
        return (c["p"] >= need) & ~c["any"]

    kind = "struct<s:int,e:int,k:int,p:double,any:boolean>"
    none = F.lit(None).cast(kind)
    some = found.withColumn("taken", F.when(F.size("proposals") == 0, F.array().cast(f"array<{kind}>")).otherwise(F.array_sort(F.filter(taken, passes))))

    def rival(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        c = acc["c"]
        meets = c.isNotNull() & (x["s"] < c["e"])
        return {"c": F.when(meets & (x["p"] <= c["p"]), c).otherwise(x)}, F.when(c.isNotNull() & ~meets, c).otherwise(none)

    # from the left on, of two that overlap the likelier stays, the first of equals
    alone = fold(F.col("taken"), {"c": none}, rival, kind, lambda acc, made: F.filter(F.concat(made, F.array(acc["c"])), lambda x: x.isNotNull()))
    added = F.transform(F.when(F.size("taken") == 0, F.array().cast(f"array<{kind}>")).otherwise(alone), lambda a: F.struct(a["s"].alias("s"), a["k"].alias("k"), a["e"].alias("e")))
    return some.withColumn("spans", F.array_sort(F.concat("base", added))).drop("taken", "proposals")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans. Texts are read once."""
    found = stored(spans(docs), "spans")
    return chosen(found, *fit(counted(found)))


def written(spans_: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the base spans' checksum, all spans, how many they are, and how many are secrets."""
    found = find(docs)
    n = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", of_kind(len(KINDS)))).cast("long").alias("n_secret"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in square brackets; n_chars, where there, is counted anew.

    Spans that overlap become one, named after the first. Texts are searched twice, for the counts that the trees
    are fitted on and in place, so that no text is shuffled or written in between. Null texts stay null.
    """
    model = fit(counted(spans(docs)))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL_KINDS))
    t = F.col("_doc.text")
    pieces = F.col("_pieces")

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        inside = x["s"] < acc["at"]
        put = F.concat(part(pieces, acc["at"], x["s"] - acc["at"]), F.get(names, x["k"]))
        return {"at": F.greatest(acc["at"], x["e"])}, F.when(inside, "").otherwise(put)

    def whole(acc: Column, made: Column) -> Column:
        rest = F.slice(pieces, F.floor(acc["at"] / PIECE).cast("int") + 1, F.size(pieces) + 1)
        return F.concat(made, F.array(F.substring(F.array_join(rest, ""), acc["at"] % PIECE + 1, F.lit(2**31 - 1))))

    # the row is held in one column, so that its names cannot clash with those made here
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))
    found = chosen(with_spans(rows, F.coalesce(t.cast("string"), F.lit(""))), *model)
    done = F.array_join(fold(F.col("spans"), {"at": F.lit(0)}, step, "string", whole), "")
    none = F.size("spans") == 0
    out = found.select("_doc", F.when(none, t).otherwise(done).alias("text"), none.alias("none"))
    columns = []
    for c in docs.columns:
        own = F.col("_doc").getField(c)
        if c == "text":
            own = F.col("text")
        elif c == "n_chars":
            own = F.when(F.col("none"), own).otherwise(F.length("text").cast(docs.schema[c].dataType))
        columns.append(own.alias(c))
    return out.select(*columns)
