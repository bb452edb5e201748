"""Secret scans through an inverted index of trigrams, on DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived that every match
satisfies.  The index has, for each trigram that some query names, the documents that contain
it (lower-cased); a rule's candidates come from intersecting those postings, and only they are
searched by its expression, and only their texts move.  A rule whose expression forces no
trigram is searched for in all.

Work grows with the text and its matches, not with their product: running places are summed
up, and texts cut, in blocks of BLOCK matches.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark_maybe, materialize, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of `regex`, leftmost and not overlapping, that have `least` characters (in `group`)."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE
BLOCK = 256
_MOST = 64  # strings that a part may stand for before it counts as anything


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which each match contains whole; None: nothing is forced.

    Parts of a sequence that stand for few strings are multiplied out; a run of them that ends
    at a part which can be anything gives the trigrams of its strings.
    """

    def strings(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(k is C.LITERAL for k, _ in arg):
            return {chr(v).lower() for _, v in arg}
        if op is C.SUBPATTERN:
            return run(arg[3])
        if op is C.BRANCH:
            parts = [run(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and (one := run(arg[2])) is not None:
            low, high, _ = arg
            if high is not C.MAXREPEAT and sum(len(one) ** n for n in range(low, high + 1)) <= _MOST:
                return {"".join(x) for n in range(low, high + 1) for x in product(one, repeat=n)}
        return None

    def run(items) -> set[str] | None:
        out = {""}
        for x in items:
            if (part := strings(*x)) is None or len(out) * len(part) > _MOST:
                return None
            out = {a + b for a in out for b in part}
        return out

    def clauses(found: set[str]) -> list[frozenset[str]] | None:
        if min(map(len, found)) < 3:
            return None
        return sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in found}, key=sorted)

    def conj(a, b):
        return a if b is None else b if a is None else [x | y for x in a for y in b]

    def walk(items) -> list[frozenset[str]] | None:
        out, now = None, {""}
        for op, arg in items:
            part = strings(op, arg)
            if part is not None and len(now) * len(part) <= _MOST:
                now = {a + b for a in now for b in part}
                continue
            out, now = conj(out, clauses(now)), {""}
            if part is not None:
                now = part
            elif op is C.SUBPATTERN:
                out = conj(out, walk(arg[3]))
            elif op is C.MAX_REPEAT and arg[0] > 0:
                out = conj(out, walk(arg[2]))
            elif op is C.BRANCH:
                parts = [walk(x) for x in arg[1]]
                out = conj(out, None if None in parts else sum(parts, []))
        return conj(out, clauses(now))

    found = walk(parser.parse(regex))
    return found and [c for c in found if not any(other < c for other in found)]  # a larger clause adds nothing


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over the trigrams that the rules' queries name: trigram, doc_id."""
    names = sorted({t for r in rules for c in trigram_query(r.regex) or () for t in c})
    low = F.lower(text_of(text_col))
    there = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return docs.select(F.col(id_col).alias("doc_id"), low.alias("_low")).select("doc_id", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that satisfy a rule's query: doc_id, kinds (array, without the rules that scan fully).

    A clause's postings are intersected by counting its trigrams for each document.
    """
    rows = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.regex) or ()) for t in c]
    terms = index.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    return (
        index.join(F.broadcast(terms), "trigram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "kind", "clause")
        .agg(F.count_distinct("trigram").alias("got"), F.first("need").alias("need"))
        .filter("got = need")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: within a lambda an expression would be, for each element."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of BLOCK."""

    def cut(own: Column) -> Column:
        n = F.ceil(F.size(own) / BLOCK).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(own, k * BLOCK + 1, BLOCK))

    return _let(items, cut)


def _running(items: Column, at: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """struct(at, out): from left to right, step(at, item) gives the next `at` and an array of what to put out."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        to, out = step(acc["at"], x)
        return F.struct(to.alias("at"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        found = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(found["at"].alias("at"), F.concat(acc["out"], F.array(found["out"])).alias("out"))

    start = F.struct(at.cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(_blocks(items), start, block, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


_SPAN = "struct<start:long,ord:int,end:long,kind:string>"


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in a text: array of (start, order, end, kind), in code points.

    The text between matches and the matches alternate, so running lengths give the places.
    """
    sizes = lambda c: F.transform(c, F.char_length)
    whole = sizes(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)))
    held = whole if rule.group == 0 else sizes(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)))
    # the last text between matches has no match after it: its entry has no len, and is cut off
    lengths = F.filter(F.arrays_zip(sizes(F.split(text, rule.regex, -1)).alias("gap"), whole.alias("len"), held.alias("held")), lambda x: x["len"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        own = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return start + x["len"], F.when(x["held"] >= rule.least, F.array(own)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return _running(lengths, F.lit(0), _SPAN, step)["out"]


def probe(rule: Rule) -> str:
    """An expression that finds something in every text where the rule keeps a match.

    Where the rule is one class of characters repeated, a run of `least` is looked for.
    """
    tree = list(parser.parse(rule.regex))
    run = len(tree) == 1 and tree[0][0] is C.MAX_REPEAT and tree[0][1][1] is C.MAXREPEAT and [op for op, _ in tree[0][1][2]] == [C.IN]
    return f"{rule.regex[:-1]}{{{rule.least},}}" if run and rule.group == 0 and rule.regex.endswith("]+") else rule.regex


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: str = "") -> DataFrame:
    """All secrets of each document: doc_id, found (array of start, ord, end, kind; sorted), text.

    With `keep`, all columns of docs stay, and found is put after them under that name.

    Places are code points, end exclusive.  A null or empty text has none; of a very long one all
    are found.  Spans that start together are in the order of the rules.  Rows that repeat an id
    share candidates, which only adds searches, and are each returned; null ids are matched as
    values.  Of an empty table the result is empty.  Columns of docs may have any names that do
    not begin with _secret.
    """
    forced = {r.kind for r in rules if trigram_query(r.regex) is not None}
    # ids and kinds of the candidates
    found = materialize(candidates(postings(docs, rules, id_col, text_col), rules).select(F.col("doc_id").alias("_secret_id"), F.col("kinds").alias("_secret_kinds")), "candidates")
    rows = mark_maybe(docs, id_col, found.select(F.col("_secret_id").alias(id_col)), "_secret_maybe")
    some = rows.filter("_secret_maybe").join(found, F.col(id_col).eqNullSafe(F.col("_secret_id")), "left").drop("_secret_id")
    rest = rows.filter("not _secret_maybe").withColumn("_secret_kinds", F.lit(None).cast("array<string>"))
    text = text_of(text_col)
    none = F.array().cast(f"array<{_SPAN}>")

    def spans(of: tuple[str, ...]) -> Column:
        parts = [F.when(F.array_contains("_secret_kinds", r.kind) if r.kind in forced else F.rlike(text, F.lit(probe(r))), _matches(text, r, i)).otherwise(none) for i, r in enumerate(rules) if r.kind in of]
        return F.array_sort(reduce(F.concat, parts)) if parts else none

    every = tuple(r.kind for r in rules)
    both = some.withColumn("_secret_found", spans(every)).unionByName(rest.withColumn("_secret_found", spans(tuple(k for k in every if k not in forced))))
    if keep:
        return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_secret_found").alias(keep))
    return both.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col("_secret_found").alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by `mask`; of spans that overlap only the first gives a mask.

    Columns and rows stay as they are; a null text stays null.
    """
    rows = scan(docs, rules, id_col, text_col, keep="_secrets")
    text = F.col(text_col)
    kind = "struct<at:long,end:long>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.array(F.struct(at.alias("at"), x["start"].alias("end")))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, gap).otherwise(F.array().cast(f"array<{kind}>"))

    kept = _running(F.col("_secrets"), F.lit(0), kind, step)  # the text before each mask, and where that after the last begins
    cut = lambda whole, a, n: F.substring(whole, (a + 1).cast("int"), n.cast("int"))

    def block(own: Column) -> Column:
        first = own[0]["at"]
        part = cut(text, first, F.element_at(own, -1)["end"] - first)
        # the part is cut out once, then its pieces are
        return F.array_join(F.transform(F.array(F.struct(part.alias("text"), first.alias("at"), own.alias("own"))), lambda s: F.array_join(F.transform(s["own"], lambda x: F.concat(cut(s["text"], x["at"] - s["at"], x["end"] - x["at"]), F.lit(mask))), "")), "")

    clean = _let(kept, lambda k: F.concat(F.array_join(F.transform(_blocks(k["out"]), block), ""), cut(text, k["at"], F.lit(2**31 - 1))))
    return rows.withColumn(text_col, F.when(F.size("_secrets") > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """What op7 returns of scan()."""
    def of(i: int) -> Column:
        return F.filter("found", lambda x: x["ord"] == i)

    own = F.filter("found", lambda x: x["ord"] < len(base))
    return scanned.select(
        "doc_id",
        *[F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)],
        F.sha2(spans_text(own), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    """op7 over documents, for DuckDB: a rule's matches and the text between them give the places."""
    parts = []
    for i, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT row, {i} AS ord, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(len(w)), lambda k: {{a: list_sum(list_transform(g[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k], lambda x: length(x))), 0), n: length(w[k + 1]), h: length(h[k + 1])}}), lambda x: x.h >= {r.least})) AS m "
            f"FROM (SELECT row, regexp_extract_all(text, '{regex}') AS w, regexp_extract_all(text, '{regex}', {r.group}) AS h, regexp_split_to_array(text, '{regex}') AS g FROM docs WHERE regexp_matches(text, '{regex}'))"
        )
    base = len(BASE)
    name = "kind || ':' || a || ':' || z"
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT row, ord, kind, m.a::BIGINT AS a, (m.a + m.n)::BIGINT AS z FROM ({" UNION ALL ".join(parts)})),
one AS (SELECT row, {counts}, string_agg({name}, ',' ORDER BY a, ord) FILTER (ord < {base}) AS base, string_agg({name}, ',' ORDER BY a, ord) AS spans FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN one USING (row)
"""


ORACLE = _sql()
