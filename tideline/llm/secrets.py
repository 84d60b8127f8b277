"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of clauses, each a disjunction
of trigram sets of which one must occur in any text that matches. Postings (trigram, document) are built for the
trigrams that the queries mention and joined with the table of the queries (rule, clause, alternative, trigram). The
postings of an alternative are intersected by uniting a bit for each of its trigrams: a document is a candidate of a rule
if each clause has an alternative with all bits. Candidates are verified with the expression itself. Rules without a
mandatory trigram (a clause can't be derived, as for runs of hexadecimal digits) scan all texts fully.

Places come from running sums over the lengths of the matches and of the texts between them, taken block by block, so
that a text of many matches costs little more than it has matches.

Trigrams are taken from the lower-cased text, so case never loses a candidate. Spans are counted in code points, end
exclusive; a rule's matches are leftmost and don't overlap, and a match that fails the rule's length is dropped.

Defined cases: null or empty text has no spans; repeated rows are each scanned (documents of one id share candidates,
which the verification sorts out); a null id is an id of its own; an empty table gives an empty result; columns other
than id and text pass unchanged in `with_spans`, and a column named like a result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops, _parser

from pyspark.sql import Column, DataFrame, functions as F

#: More strings than this are not enumerated while deriving a query.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` must mean the same in Java and Python; `value` is the group whose length must reach `least`."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


#: The base rules in their order.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further public token formats.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + FURTHER


def _members(items: list) -> set[str] | None:
    """Lower-cased characters of a set, None if they are many."""
    out: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            out.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


class _Query:
    """Walks an expression: `strings` are all texts that the part since the last flush can have, or None."""

    def __init__(self) -> None:
        self.clauses: list[set[frozenset[str]]] = []
        self.strings: set[str] = {""}

    def flush(self) -> None:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.strings}
        if frozenset() not in options:
            self.clauses.append({o for o in options if not any(x < o for x in options)})
        self.strings = {""}

    def append(self, more: set[str] | None) -> None:
        if more is None:
            self.flush()
            return
        if len(self.strings) * len(more) > MAX_STRINGS:
            self.flush()
        self.strings = {a + b for a in self.strings for b in more} if len(more) <= MAX_STRINGS else {""}

    def walk(self, tree) -> None:
        for op, value in tree:
            if op is ops.LITERAL:
                self.append({chr(value).lower()})
            elif op is ops.IN:
                self.append(_members(value))
            elif op is ops.SUBPATTERN:
                self.walk(value[3])
            elif op is ops.BRANCH:
                self.append(_strings(_parser.SubPattern(tree.state, [(op, value)])))
            elif op is ops.MAX_REPEAT:
                least, most, inner = value
                own = _strings(inner)
                if own is not None and least == 0 and most == 1:
                    self.append(own | {""})
                    continue
                if own is not None:
                    for _ in range(min(least, 3)):
                        self.append(own)
                if own is None or most != least or least > 3:
                    self.flush()
            else:
                self.flush()


def _strings(tree) -> set[str] | None:
    """All lower-cased texts of a small expression, None if they are many or unbounded."""
    out = {""}
    for op, value in tree:
        if op is ops.LITERAL:
            own = {chr(value).lower()}
        elif op is ops.IN:
            own = _members(value)
        elif op is ops.SUBPATTERN:
            own = _strings(value[3])
        elif op is ops.BRANCH:
            parts = [_strings(x) for x in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op is ops.MAX_REPEAT and value[0] == 0 and value[1] == 1:
            own = _strings(value[2])
            own = own and own | {""}
        else:
            own = None
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses (and) of alternatives (or) of trigrams (and); empty if no trigram is mandatory."""
    query = _Query()
    query.walk(_parser.parse(pattern))
    query.flush()
    return [sorted(sorted(x) for x in clause) for clause in query.clauses]


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(key, kinds): bit k is set for a document that rule k can match by its trigrams, from intersected postings."""
    queries = [(k, trigram_query(r.pattern)) for k, r in enumerate(rules)]
    grams = sorted({g for _, q in queries for clause in q for option in clause for g in option})
    number = {g: k for k, g in enumerate(grams)}
    terms = [
        (number[g], k, c, o, 1 << at, (1 << len(option)) - 1, (1 << len(query)) - 1)
        for k, query in queries for c, clause in enumerate(query) for o, option in enumerate(clause) for at, g in enumerate(option)
    ]
    schema = "gram int, rule int, clause int, option int, bit long, whole long, clauses long"
    index = F.broadcast(docs.sparkSession.createDataFrame(terms, schema))  # a row for each trigram of each alternative of the rules
    low = docs.select(F.col(key).alias("_key_"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    postings = low.select("_key_", F.explode(present).alias("gram"))
    hits = postings.join(index, "gram").select("_key_", "rule", "clause", "option", "whole", "clauses", "bit").repartition("_key_")
    options = hits.groupBy("_key_", "rule", "clause", "option", "whole", "clauses").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    held = options.groupBy("_key_", "rule", "clauses").agg(F.bit_or(F.expr("shiftleft(1L, clause)")).alias("bits")).where("bits = clauses")
    return held.groupBy("_key_").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_kinds_"))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once; inside a lambda any other expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step) -> Column:
    """What `step` makes of the values before each place, and before the end: one longer than `values`.

    Two levels: the blocks are about as long as they are many, so n values cost n ** 1.5 steps; appending to a list would copy
    it each time and cost n ** 2.
    """

    def placed(v: Column, block: Column) -> Column:
        folded = lambda at, n, first: F.aggregate(F.slice(v, at, n), first, step)
        blocks = F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int"))
        sums = F.transform(blocks, lambda b: folded(b * block + 1, block, start))
        heads = let(sums, lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda b: F.aggregate(F.slice(own, F.lit(1), b), start, step)))
        inside = lambda i: F.pmod(i, block)
        at = lambda i, h: folded(i - inside(i) + 1, inside(i), F.get(h, F.floor(i / block).cast("int")))
        return let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.size(v)), lambda i: at(i, h)))

    root = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
    return let(values, lambda v: let(root(v), lambda block: placed(v, block)))


SPAN = "array<struct<start:int,kind_order:int,end:int,kind:string,length:int,from_byte:int,to_byte:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text: the lengths of the matches and of the texts between them add up to the places."""

    def place(row: Column) -> Column:
        begin, first = row["at"] + F.length(row["gap"]), row["byte"] + F.octet_length(row["gap"])
        return F.struct(
            begin.alias("start"), F.lit(order).alias("kind_order"), (begin + F.length(row["m"])).alias("end"), F.lit(rule.kind).alias("kind"), F.length(row["v"]).alias("length"),
            first.alias("from_byte"), (first + F.octet_length(row["m"])).alias("to_byte"),
        )

    def placed(found: Column, between: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)) if rule.value else found
        sizes = lambda measure: F.zip_with(between, found, lambda gap, n: measure(gap) + F.coalesce(measure(n), F.lit(0)))
        char_at, byte_at = (running(sizes(m), F.lit(0), lambda a, x: a + x) for m in (F.length, F.octet_length))
        rows = F.arrays_zip(found.alias("m"), values.alias("v"), between.alias("gap"), char_at.alias("at"), byte_at.alias("byte"))
        return F.transform(F.filter(rows, lambda row: row["m"].isNotNull() & (F.length(row["v"]) >= rule.least)), place)

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda found: let(F.split(text, rule.pattern, -1), lambda between: placed(found, between)))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with secret_spans: array of (start, kind_order, end, kind, length, from_byte, to_byte), by start and then rule order."""
    base = docs.drop("secret_spans")
    kinds = candidates(base.select(key, text), rules, key, text)
    joined = base.join(kinds, base[key].eqNullSafe(kinds["_key_"]), "left").drop("_key_")
    none = F.array().cast(SPAN)
    chosen = lambda k: F.coalesce(F.col("_kinds_").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
    parts = [
        F.when(chosen(k) if trigram_query(r.pattern) else F.rlike(F.col(text), F.lit(r.pattern)), spans(F.col(text), r, k)).otherwise(none)
        for k, r in enumerate(_plain(rules))
    ]
    own = F.array_sort(F.concat(*(F.coalesce(p, none) for p in parts)))
    return joined.withColumn("secret_spans", own).drop("_kinds_")


def _plain(rules: tuple[Rule, ...]) -> list[Rule]:
    """A run of one class of `least` or more is the same as a maximal run that is then measured, and cheaper to find."""
    run = re.compile(r"(\[[^\]\\]+\])\+")
    return [Rule(r.kind, f"{m[1]}{{{r.least},}}", 0, r.least) if (m := run.fullmatch(r.pattern)) else r for r in rules]


def joined_spans(column: Column, kinds: set[str] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    rows = column if kinds is None else F.filter(column, lambda x: x["kind"].isin(*sorted(kinds)))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its text replaced by `mark` (overlapping spans by one); a null text stays null."""
    found = with_spans(docs, rules, key, text)
    ends = F.transform("secret_spans", lambda x: x["to_byte"])
    covered = running(ends, F.lit(0), lambda a, x: F.greatest(a, x))  # how far the spans before each one reach
    rows = F.filter(F.arrays_zip(F.col("secret_spans").alias("span"), covered.alias("upto")), lambda x: x["span"].isNull() | (x["span"]["from_byte"] >= x["upto"]))
    raw = F.col(text).cast("binary")

    def piece(data: Column, row: Column) -> Column:
        """The text between two spans and the mark; after the last span only the rest of the text."""
        begin, stop = row["upto"], F.coalesce(row["span"]["from_byte"], F.octet_length(data))
        own = F.substring(data, begin + 1, stop - begin).cast("string")
        return F.when(row["span"].isNull(), own).otherwise(F.concat(own, F.lit(mark)))

    clean = F.when(F.size("secret_spans") > 0, F.array_join(let(raw, lambda data: F.transform(rows, lambda row: piece(data, row))), "")).otherwise(F.col(text))
    return found.withColumn(text, clean).drop("secret_spans")
