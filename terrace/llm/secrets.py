"""Secret scans by a trigram index.

Each rule is a regular expression; from its syntax a Boolean query over trigrams is derived that every match must
satisfy (letters compared in lower case). The index holds the postings (trigram, document) of the trigrams that the
rules' queries name. Intersecting postings leaves candidates for each rule, and only these are verified with the
expression; a rule without a mandatory trigram, such as a run of hexadecimal digits, is verified on every text.

Defined cases: null and empty text have no matches; null doc_id is kept as it is; repeated rows each give a row (the
index knows a document by id and text); of matches that start together the rules' order decides; an empty table
gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, written

FEW = 200_000
#: Matches of one kind in a text that are placed by one fold.
SHORT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and apart; one counts if ``group`` (0: all of it) has ``least`` characters.

    ``base`` rules make up the digest; others only add spans.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: The three kinds of the contract, then kinds that add spans. A run of one class of characters is found
#: whole, so that its least length can stand in the pattern and shorter runs need not be listed.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
)

# A query is None (anything matches) or a set of clauses, each a set of trigrams: one clause's trigrams must all be there.
Query = frozenset


def _grams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query | None:
    """Clauses of trigrams, one of which every match has in full; None if no trigram is mandatory.

    The syntax tree is walked with the set of literal strings that the part read last can be; as long as that set
    is known it is lengthened, else it is closed and its trigrams are required.
    """
    from re import _constants as c
    from re import _parser as parser

    most = 64

    def literals(tree) -> set[str] | None:
        """All strings that ``tree`` can be, if they are few."""
        out = {""}
        for op, arg in tree:
            if op is c.LITERAL:
                more = {chr(arg)}
            elif op is c.SUBPATTERN:
                more = literals(arg[3])
            elif op is c.BRANCH:
                parts = [literals(t) for t in arg[1]]
                more = None if any(p is None for p in parts) else set().union(*parts)
            elif op is c.MAX_REPEAT and arg[1] <= 1:
                inner = literals(arg[2])
                more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            elif op is c.IN and all(o is c.LITERAL for o, _ in arg):
                more = {chr(a) for _, a in arg}
            else:
                return None
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a in out for b in more}
        return out

    runs: list[set[str]] = [{""}]
    for item in parser.parse(pattern):
        more = literals([item])
        if more is None or len(runs[-1]) * len(more) > most:
            runs.append({""})
        else:
            runs[-1] = {a + b for a in runs[-1] for b in more}
    # a run whose every string has a trigram is a clause set; the one with the fewest strings is asked for
    usable = [r for r in runs if all(len(x) >= 3 for x in r)]
    if not usable:
        return None
    clauses = {_grams(x) for x in min(usable, key=lambda r: (len(r), sorted(r)))}
    return Query(x for x in clauses if not any(y < x for y in clauses))


def row_tag(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (gram, tag), the place of a trigram among ``trigrams`` and a document that has it."""
    folded = docs.select(row_tag(docs).alias("tag"), F.lower(docs["text"]).alias("low"))
    there = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams))))
    return folded.select("tag", F.explode(there).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(tag, rules): documents whose postings satisfy the query of some rule that has one, and which rules."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in asked.values() for clause in q for g in clause})
    index = postings(docs, grams)
    place = {g: i for i, g in enumerate(grams)}
    # intersecting postings: a document's trigrams as bits, in words of 63
    words = [F.bit_or(F.when(F.col("gram").between(w * 63, w * 63 + 62), F.expr(f"shiftleft(1L, gram - {w * 63})")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in range(-(-len(grams) // 63))]
    bits = index.groupBy("tag").agg(*words)

    def holds(query: Query) -> Column:
        out = F.lit(False)
        for clause in sorted(query, key=sorted):
            every = F.lit(True)
            for w in range(len(words)):
                mask = sum(1 << (place[g] - w * 63) for g in clause if place[g] // 63 == w)
                if mask:
                    every = every & (F.col(f"bits{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
            out = out | every
        return out

    named = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in asked.items())))
    return bits.select("tag", named.alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, stop, kind) of a rule's matches, in order: between matches stand the parts of a split."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(sizes, F.length).alias("inner"))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    return F.when(F.size(found) > 0, F.transform(F.array(rows), lambda r: in_place(r, rule))[0]).otherwise(none)


def in_place(rows: Column, rule: Rule) -> Column:
    """``rows(gap, len, inner)``, at least one, as spans in order.

    A fold that appends copies what it has, so matches are folded in about sqrt(n) chunks of sqrt(n): first the
    chunks' starts, then each chunk's spans from its start.
    """
    n = F.size(rows)
    chunk = F.when(n <= SHORT, n).otherwise(F.ceil(F.sqrt(n))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.slice(rows, c * chunk + 1, chunk))
    spans = "array<struct<start:int,stop:int,inner:int>>"

    def start_next(a: Column, of: Column) -> Column:
        end = F.aggregate(of, a["end"], lambda e, r: e + r["gap"] + r["len"])
        one = F.array(F.struct(a["end"].alias("start"), of.alias("rows")))
        return F.struct(end.alias("end"), F.concat(a["out"], one).alias("out"))

    def add(a: Column, r: Column) -> Column:
        start = a["end"] + r["gap"]
        stop = start + r["len"]
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), r["inner"].alias("inner")))
        return F.struct(stop.alias("end"), F.concat(a["out"], one).alias("out"))

    held = F.array().cast("array<struct<start:int,rows:array<struct<gap:int,len:int,inner:int>>>>")
    begun = F.aggregate(chunks, F.struct(F.lit(0).alias("end"), held.alias("out")), start_next, lambda a: a["out"])
    each = F.transform(begun, lambda c: F.aggregate(c["rows"], F.struct(c["start"].alias("end"), F.array().cast(spans).alias("out")), add, lambda a: a["out"]))
    kept = F.filter(F.flatten(each), lambda s: s["inner"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, one array of spans for each rule) for each row of ``docs``."""
    found = written(candidates(docs, rules), "candidates")
    found = F.broadcast(found) if is_small(found, FEW) else found
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), row_tag(docs).alias("row")).join(found.withColumnRenamed("tag", "row"), "row", "left")
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    out = []
    for rule in rules:
        spans = spans_of(F.col("text"), rule)
        if trigram_query(rule.pattern) is not None:
            spans = F.when(F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)), spans).otherwise(none)
        out.append(spans.alias(rule.kind))
    return rows.select("doc_id", *out)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then by place of the kind."""
    order = F.array(*(F.lit(k) for k in kinds))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row, with a count for each base rule."""
    rows = secret_spans(docs, rules)
    kinds = tuple(r.kind for r in rules)
    base = [r.kind for r in rules if r.base]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(F.concat(*(F.col(k) for k in base)), kinds).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, joined(F.concat(*(F.col(k) for k in kinds)), kinds).alias("spans"))
