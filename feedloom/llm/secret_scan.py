"""Secrets in texts, found through a trigram inverted index. DataFrame functions only.

For each rule a Boolean query over trigrams is derived from its pattern: a disjunction of sets of trigrams, one of which every match
must contain whole. The index lists, for each trigram that some rule asks for, the documents whose lower-cased text has it;
intersecting its postings leaves candidates, and only their texts are searched with the pattern. Rules whose patterns have
no mandatory trigram search every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as regex_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import id_text, literal_table, text_key
from feedloom.session import materialise


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length decides, and the least length; matches that fall short are dropped.
    group: int = 0
    least: int = 1


#: The three base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 or more are the same as runs cut at no length and dropped below 16, and there are far fewer of them.
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further formats of public services.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!*-]+@"),
)

# ---- trigram queries ----

#: Strings that a stretch of a pattern may stand for; beyond so many it counts as unknown.
ALTERNATIVES = 32


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _segments(parsed) -> list[set[str]]:
    """The pattern as stretches of known strings; between two of them anything may stand. The first and last may touch the outside."""
    done: list[set[str]] = []
    now = {""}

    def add(strings: set[str]) -> None:
        nonlocal now
        joined = {a + b for a in now for b in strings}
        if len(joined) > ALTERNATIVES:
            done.append(now)
            joined = strings if len(strings) <= ALTERNATIVES else {""}
        now = joined

    def gap() -> None:
        nonlocal now
        done.append(now)
        now = {""}

    for op, value in parsed:
        if op is rc.LITERAL:
            add({chr(value).lower()})
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in value) and len(value) <= 6:
            add({chr(v).lower() for _, v in value})
        elif op in (rc.SUBPATTERN, rc.BRANCH, rc.ATOMIC_GROUP):
            branches = value[1] if op is rc.BRANCH else [value[-1] if op is rc.SUBPATTERN else value]
            inner = [_segments(b) for b in branches]
            if all(len(s) == 1 for s in inner):
                add(set().union(*(s[0] for s in inner)))
            elif len(inner) == 1:
                add(inner[0][0])
                for middle in inner[0][1:]:
                    gap()
                    add(middle)
            else:
                gap()
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, sub = value
            inner = _segments(sub)
            if low == 0 and high == 1 and len(inner) == 1:
                add(inner[0] | {""})
            elif low == high and len(inner) == 1 and low * max(map(len, inner[0])) <= 64:
                for _ in range(low):
                    add(inner[0])
            elif low and len(inner) == 1:
                add(inner[0])
                gap()
                add(inner[0])
            else:
                gap()
        elif op is not rc.AT:
            gap()
    return [*done, now]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, in lower case: every match contains all of at least one set. Empty if the pattern has no mandatory trigram."""
    choices = []
    for strings in _segments(regex_parser.parse(pattern)):
        sets = {_trigrams(s) for s in strings}
        if frozenset() not in sets:
            choices.append({s for s in sets if not any(t < s for t in sets)})
    if not choices:
        return []
    combined = choices[0]
    for more in choices[1:]:
        if len(combined) * len(more) <= ALTERNATIVES:
            combined = {a | b for a, b in product(combined, more)}
    return sorted(combined, key=sorted)


# ---- the jobs ----


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, _key): the postings of ``trigrams`` over the lower-cased texts of docs (doc_id, _key, text)."""
    wanted = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    return docs.select(F.explode(held).alias("trigram"), "doc_id", "_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, _key, kinds): documents that satisfy the query of at least one rule, and which."""
    asked = [(r.kind, n, t, len(s)) for r in rules for n, s in enumerate(trigram_query(r.pattern)) for t in sorted(s)]
    terms = literal_table(index.sparkSession, asked, "kind string, choice int, _trigram string, needed int")
    hits = index.distinct().join(F.broadcast(terms), index.trigram == terms["_trigram"])  # as many rows as the rules have trigrams
    met = hits.groupBy("doc_id", "_key", "kind", "choice").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("doc_id", "_key").agg(F.collect_set("kind").alias("kinds"))  # at most one per rule


def _pieces(docs: DataFrame, rule: Rule, order: int, wanted: Column) -> DataFrame:
    """One row per match: the code points between the match before and this one, its length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    whole, part = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(rule.group))
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")), lambda m: F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("size"), (F.length(m["part"]) >= rule.least).alias("counts")))
    found = docs.where(wanted & F.col("text").rlike(rule.pattern)).select("doc_id", "_key", F.posexplode(zipped).alias("at", "m"))
    return found.select("doc_id", "_key", F.lit(order).alias("rule"), "at", "m.*").where("size is not null")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, _key, kind, rule, start, end) of every match that counts, of docs (doc_id, _key, text); repeated rows count once.

    Positions are code points, the end exclusive. Matches are leftmost and do not overlap within a rule; a dropped match
    still takes up its place.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    trigrams = sorted(set().union(*(s for r in indexed for s in trigram_query(r.pattern))))
    index = materialise(trigram_index(docs, trigrams))
    chosen = candidates(index, indexed).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "kinds")
    texts = docs.join(chosen, docs.doc_id.eqNullSafe(chosen["_id"]) & (docs["_key"] == chosen["_k"])).select("doc_id", "_key", "text", "kinds")
    if indexed:
        texts = materialise(texts)
    parts = []
    for order, rule in enumerate(rules):
        if rule in indexed:
            parts.append(_pieces(texts, rule, order, F.array_contains("kinds", rule.kind)))
        else:
            parts.append(_pieces(docs, rule, order, F.lit(True)))
    pieces = reduce(DataFrame.unionByName, parts).repartition("doc_id", "_key")
    pieces = pieces.groupBy("doc_id", "_key", "rule", "at").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "_key", "rule").orderBy("at"))
    placed = pieces.withColumn("end", so_far).where("counts")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    return placed.select("doc_id", "_key", kind.alias("kind"), "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row per input row: spans of (start, rule, end, kind) by start, then by the order of the rules.

    Null and empty texts have no spans. Rows that repeat id and text get the same spans; null ids are kept. Other columns are not read.
    """
    keyed = id_text(docs, id_col, text_col).withColumn("_key", text_key("text"))
    found = secret_spans(keyed, rules)
    listed = found.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end", "kind"))).alias("spans"))  # of one document
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "spans")
    narrow = keyed.select("doc_id", "_key")
    joined = narrow.join(listed, narrow.doc_id.eqNullSafe(listed["_id"]) & (narrow["_key"] == listed["_k"]), "left")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans"))
