"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned, on the driver, into a Boolean query over trigrams that every match
must hold. Postings of those trigrams are intersected to candidates, which the regular expressions verify.
A rule without mandatory trigrams is run over every text.
"""

from __future__ import annotations

import re._constants as node
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Strings that one spot of a pattern may expand to before the query gives up on telling them apart.
MOST_FORMS = 64


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share; group: the part that must have `least` characters (0: all)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

Query = frozenset  # of frozensets of trigrams: any of them, with all of its trigrams; a query that holds the empty set says nothing
ANY: Query = frozenset([frozenset()])


def _all_of(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_forms(forms: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in forms))


def _forms(op, arg, fold: bool) -> set[str] | None:
    """The strings that a node of one character may match, if they are few."""
    if op is node.LITERAL:
        return {chr(arg).lower() if fold else chr(arg)}
    if op is node.IN and all(x is node.LITERAL for x, _ in arg):
        found = {chr(v).lower() if fold else chr(v) for _, v in arg}
        return found if len(found) <= 4 else None
    return None


def _walk(seq, fold: bool) -> tuple[set[str] | None, Query]:
    """All strings that seq matches, if they are few, and the trigrams it asks for otherwise."""
    forms: set[str] = {""}
    whole, query = True, ANY
    for op, arg in seq:
        part, asked = _forms(op, arg, fold), ANY
        if op is node.SUBPATTERN:
            part, asked = _walk(arg[-1], fold)
        elif op is node.BRANCH:
            found = [_walk(x, fold) for x in arg[1]]
            if all(f is not None for f, _ in found):
                part = set().union(*(f for f, _ in found))
            else:
                asked = _least(frozenset().union(*((_of_forms(f) if f is not None else q) for f, q in found)))
        elif op in (node.MAX_REPEAT, node.MIN_REPEAT):
            low, high, body = arg
            inner, q = _walk(body, fold)
            if inner is not None and (low, high) == (0, 1):
                part = inner | {""}
            elif inner is not None and low == high <= 4:
                part = {"".join(x) for x in product(inner, repeat=low)}
            elif low:
                asked = _of_forms(inner) if inner is not None else q
        elif op is node.AT or op in (node.ASSERT, node.ASSERT_NOT):
            part = {""}
        if part is not None and len(forms) * len(part) <= MOST_FORMS:
            forms = {a + b for a, b in product(forms, part)}
            continue
        query = _all_of(_all_of(query, _of_forms(forms)), asked if part is None else _of_forms(part))
        forms, whole = {""}, False
    return (forms, _of_forms(forms)) if whole else (None, _all_of(query, _of_forms(forms)))


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """Alternatives, each a list of trigrams that a match holds all of; None if there is no such query.

    For a rule that ignores case the trigrams are of lower-cased text.
    """
    forms, query = _walk(parser.parse(rule.pattern), rule.ignore_case)
    query = _of_forms(forms) if forms is not None else query
    return None if frozenset() in query else sorted(sorted(x) for x in query)


def _names(rules) -> list[tuple[bool, str]]:
    return sorted({(r.ignore_case, t) for r in rules for x in trigram_query(r) or [] for t in x})


def _keyed(docs: DataFrame) -> DataFrame:
    """Ids may repeat or be null, so a row's key holds a hash of its text too; rows of one key are the same row."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram (its number among the rules' trigrams), doc_id, text_key: the inverted index, of those trigrams that a query can ask for."""
    names = _names(rules)
    low = _keyed(docs).withColumn("low", F.lower("text"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low" if fold else "text"), F.lit(t)), F.lit(i)) for i, (fold, t) in enumerate(names))))
    return low.select("doc_id", "text_key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_key, kinds: the rules whose query the postings meet.

    The rules' alternatives, a table of fixed size, meet the postings at their trigrams; a text in the postings of all
    trigrams of an alternative is in their intersection.
    """
    number = {t: i for i, t in enumerate(_names(rules))}
    asked = [(number[r.ignore_case, t], r.kind, k, len(x)) for r in rules for k, x in enumerate(trigram_query(r) or []) for t in x]
    terms = index.sparkSession.createDataFrame(asked, "trigram int, kind string, alternative int, needed int")
    met = index.join(F.broadcast(terms), "trigram").groupBy("doc_id", "text_key", "kind", "alternative", "needed").agg(F.size(F.collect_set("trigram")).alias("held"))
    return met.where("held = needed").groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


#: Items of an array that are added up one by one; longer arrays are taken in pieces, as each step copies what it has so far.
PIECE = 256


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_pieces(items: Column, first: Column, total: Callable[[Column], Column], add: Callable[[Column, Column], Column], run: Callable[[Column, Column], Column]) -> Column:
    """run(piece, state before it) of each PIECE items of an array; states follow each other by add(state, total(piece)).

    So nothing grows with the square of the array but the states, of which there are PIECE times fewer.
    """

    def worked(every: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PIECE).cast("int")), lambda i: F.slice(every, i * PIECE + 1, PIECE))

        def stated(cut: Column) -> Column:
            start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("states"))
            states = F.aggregate(F.transform(cut, total), start, lambda acc, t: F.struct(add(acc.at, t).alias("at"), F.concat(acc.states, F.array(acc.at)).alias("states")), lambda acc: acc.states)
            return F.zip_with(cut, states, run)

        return _with(pieces, stated)

    return F.when(F.size(items) > 0, _with(items, worked))


def _spans(rule: Rule, number: int) -> Column:
    """array<struct<at, kind, upto>> of the rule's leftmost non-overlapping matches in `text`, in code points.

    The text between matches and the matches themselves alternate, so their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    match, part = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(rule.group))
    sizes = F.zip_with(match, part, lambda m, p: F.struct(F.length(m).alias("n"), F.length(p).alias("p")))
    pieces = F.zip_with(F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x)), sizes, lambda gap, m: F.struct(gap.alias("gap"), m.n.alias("n"), m.p.alias("p")))
    span = "array<struct<at:int,kind:int,upto:int>>"

    def step(acc, x):
        at = acc.at + x.gap
        upto = at + F.coalesce(x.n, F.lit(0))
        kept = F.when(x.p >= rule.least, F.concat(acc.out, F.array(F.struct(at.alias("at"), F.lit(number).alias("kind"), upto.alias("upto"))))).otherwise(acc.out)
        return F.struct(upto.alias("at"), kept.alias("out"))

    length = lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + x.gap + F.coalesce(x.n, F.lit(0)))
    placed = lambda piece, at: F.aggregate(piece, F.struct(at.alias("at"), F.array().cast(span).alias("out")), step, lambda acc: acc.out)
    return F.flatten(_in_pieces(pieces, F.lit(0), length, lambda at, n: at + n, placed))


def _quick(rule: Rule) -> Column:
    """Whether `text` has any match that counts; for rules without a candidate list this spares most texts the splitting."""
    return F.col("text").rlike(_least_pattern(rule)) if rule.group == 0 else F.lit(True)


def _least_pattern(rule: Rule) -> str:
    """The pattern with its closing + asking for the least length, for rules of which that is the whole length."""
    head = rule.pattern[:-1]
    fixed = len(head[: head.index("[")]) if "[" in head else len(head)
    return f"{head}{{{max(1, rule.least - fixed)},}}"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans (array<struct<at, kind, upto>> by at, then rule) of each row, and rest, a struct of the columns `keep`.

    Null texts count as empty, have no spans; equal rows give equal rows; null ids are kept. Other columns are left behind.
    """
    more = [F.struct(*keep).alias("rest")] if keep else []
    docs = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more))
    found = candidates(postings(docs.select("doc_id", "text"), rules), rules)
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "kinds")
    joined = docs.join(found, (F.col("found_key") == docs.text_key) & F.col("found_id").eqNullSafe(docs.doc_id), "left")
    none = F.array().cast("array<struct<at:int,kind:int,upto:int>>")
    parts = []
    for i, r in enumerate(rules):
        due = F.array_contains("kinds", r.kind) if trigram_query(r) is not None else _quick(r)
        parts.append(F.when(F.coalesce(due, F.lit(False)), _spans(r, i)).otherwise(none))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"), *(["rest"] if keep else []))


def mask(text: Column, spans: Column, by: str = "*") -> Column:
    """The text with each span's characters replaced, its length kept; spans are in order and may overlap.

    The text is taken apart into characters once, and the pieces between spans are joined once.
    """

    def masked(letters: Column) -> Column:
        def step(acc, s):
            low = F.greatest(s.at, acc.at)
            n = F.greatest(s.upto - low, F.lit(0))
            pieces = F.array(F.array_join(F.slice(letters, acc.at + 1, F.greatest(low - acc.at, F.lit(0))), ""), F.repeat(F.lit(by), n))
            return F.struct(F.greatest(s.upto, acc.at).alias("at"), F.when(n > 0, F.concat(acc.out, pieces)).otherwise(acc.out).alias("out"))

        start = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        joined = _in_pieces(spans, F.lit(0), lambda piece: F.array_max(F.transform(piece, lambda s: s.upto)), F.greatest, lambda piece, at: F.aggregate(piece, start(at), step, lambda acc: F.array_join(acc.out, "")))
        end = F.array_max(F.transform(spans, lambda s: s.upto))
        return F.concat(F.array_join(joined, ""), F.array_join(F.slice(letters, end + 1, F.greatest(F.size(letters) - end, F.lit(0))), ""))

    return F.when(F.size(spans) == 0, text).otherwise(_with(F.split(text, ""), masked))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    told = F.concat_ws(",", F.transform("spans", lambda s: F.concat(F.element_at(kinds, s.kind + 1), F.lit(":"), s.at.cast("string"), F.lit(":"), s.upto.cast("string"))))
    found = F.transform("spans", lambda s: s.kind)
    counts = [F.size(F.filter(found, F.lit(i).__eq__)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    out = scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, told.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
