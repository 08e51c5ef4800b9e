"""Boolean queries: ``&&``, ``||``, ``!``, parentheses, implicit AND; never an error.

A query becomes a postfix program on the driver, which runs over columns: one flag for each term
and document. Operators without operands are skipped, unmatched parentheses ignored, and the last
value left is the answer, so malformed queries have defined results too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions.text import QUERY_STOP_WORDS, query_term_of
from wordmill.operators.index import Index

_STOP = frozenset(QUERY_STOP_WORDS)
_LEX = re.compile(r"&&|\|\||!|\(|\)|[^\s()!&|]+|[&|]")
_RANK = {"!": 3, "&&": 2, "||": 1}
OPERATORS = frozenset(_RANK) | {"(", ")"}


def is_boolean(query: str) -> bool:
    """Whether a query asks for the boolean mode; parentheses alone don't."""
    return any(op in query for op in ("&&", "||", "!"))


def lex(query: str, yo_to_e: bool = True) -> list[str]:
    """Operators and normalised terms; stop words and empty ones vanish without a trace."""
    out = []
    for m in _LEX.finditer(query):
        t = m.group()
        if t in OPERATORS:
            out.append(t)
            continue
        term = query_term_of(t, yo_to_e)
        if term and term not in _STOP:
            out.append(term)
    return out


def with_implicit_and(tokens: list[str]) -> list[str]:
    """AND between a term or ``)`` and a term, ``(`` or ``!``."""
    out: list[str] = []
    for t in tokens:
        if out and (out[-1] not in OPERATORS or out[-1] == ")") and (t not in OPERATORS or t in ("(", "!")):
            out.append("&&")
        out.append(t)
    return out


def postfix(tokens: list[str]) -> list[str]:
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        if t not in OPERATORS:
            out.append(t)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            # NOT is right associative, the others left.
            while stack and stack[-1] != "(" and (_RANK[stack[-1]] > _RANK[t] or (_RANK[stack[-1]] == _RANK[t] and t != "!")):
                out.append(stack.pop())
            stack.append(t)
    while stack:
        out.append(stack.pop())
    return [t for t in out if t != "("]


def program(query: str, yo_to_e: bool = True) -> list[str]:
    return postfix(with_implicit_and(lex(query, yo_to_e)))


def evaluate(code: list[str], value, both, either, negate):
    """Runs a program over any set algebra; None for a query without a value."""
    stack = []
    for t in code:
        if t == "!":
            if stack:
                stack.append(negate(stack.pop()))
        elif t in ("&&", "||"):
            if len(stack) >= 2:
                b, a = stack.pop(), stack.pop()
                stack.append((both if t == "&&" else either)(a, b))
        else:
            stack.append(value(t))
    return stack[-1] if stack else None


def scoring_words(query: str, yo_to_e: bool = True) -> list[str]:
    """Words that give scores: split at white space only, so ``a(b`` is one word here."""
    words = [query_term_of(w, yo_to_e) for w in query.split()[:64]]
    return [w for w in words if w and w not in _STOP]


@dataclass
class Plan:
    code: list[str]
    terms: list[str]
    words: list[str]

    @classmethod
    def of(cls, query: str, yo_to_e: bool = True) -> Plan:
        code = program(query, yo_to_e)
        words = scoring_words(query, yo_to_e)
        terms = list(dict.fromkeys([t for t in code if t not in OPERATORS] + words))
        return cls(code, terms, words)

    @property
    def matches_empty(self) -> bool:
        """Whether a document without any of the terms is a match, so the whole universe is asked for."""
        return bool(evaluate(self.code, lambda t: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a))

    def condition(self) -> Column | None:
        flags = {t: F.coalesce(F.col(f"f{k}"), F.lit(False)) for k, t in enumerate(self.terms)}
        return evaluate(self.code, flags.__getitem__, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def matches(index: Index, query: str, yo_to_e: bool = True) -> DataFrame:
    """(doc_id) of the documents that match: one scan of the terms' postings and one shuffle."""
    plan = Plan.of(query, yo_to_e)
    universe = index.docs.select("doc_id").distinct()
    cond = plan.condition()
    if cond is None:
        return universe.where(F.lit(False))
    hits = index.postings.where(F.col("term").isin(plan.terms)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f"f{k}") for k, t in enumerate(plan.terms)))
    if plan.matches_empty:
        hits = universe.join(hits, "doc_id", "left")
    return hits.where(cond).select("doc_id")


def matches_by_sets(index: Index, query: str, yo_to_e: bool = True) -> DataFrame:
    """The same by INTERSECT, UNION and EXCEPT over lists of documents: a cross-check."""
    universe = index.docs.select("doc_id").distinct()
    lists = lambda t: index.postings.where(F.col("term") == t).select("doc_id").distinct()
    found = evaluate(program(query, yo_to_e), lists, lambda a, b: a.intersect(b), lambda a, b: a.union(b).distinct(), lambda a: universe.exceptAll(a.intersect(universe)))
    return universe.where(F.lit(False)) if found is None else found


def page(rows: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A window of ordered rows; a negative offset is 0, a limit that isn't positive 50."""
    offset, limit = max(0, offset), limit if limit > 0 else 50
    return rows.offset(offset).limit(limit) if offset else rows.limit(limit)


def boolean_search(index: Index, query: str, offset: int = 0, limit: int = 50, yo_to_e: bool = True) -> DataFrame:
    """(doc_id, title, url) in order of ids."""
    top = page(matches(index, query, yo_to_e).orderBy("doc_id"), offset, limit)
    return top.join(index.docs, "doc_id").select("doc_id", "title", "url").repartition(1).sortWithinPartitions("doc_id")


