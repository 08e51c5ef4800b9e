"""Ranked retrieval: candidates by the boolean program, scores by weighted terms over the document's norm."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.text import count_sql, log_count, log_number, log_of
from wordmill.operators.index import Index
from wordmill.plans.query import OPERATORS, Plan, boolean_search, evaluate, is_boolean, page, program


def scores(index: Index, query: str, yo_to_e: bool = True) -> DataFrame:
    """(doc_id, score) of the documents with a positive sum of weights.

    A term's postings are read once: flags for the program and the score come from one
    aggregation by document; their df comes from the dictionary."""
    plan = Plan.of(query, yo_to_e)
    cond = plan.condition()
    if cond is None or not plan.words:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    times = Counter(plan.words)
    df = index.frequencies(plan.terms)
    # Terms are letters and digits only. Expressions as text: a plan of few calls is made sooner.
    asked = " or ".join(f"term = '{t}'" for t in plan.terms)
    factor = " ".join(f"when '{t}' then {log_number(index.n_docs / df[t], index.log_mode) * n!r}D" for t, n in times.items() if t in df)
    total = f"sum((1 + {count_sql('tf', index.log_mode)}) * case term {factor} else 0D end)" if factor else "0D"
    flags = [F.expr(f"max(term = '{t}') f{k}") for k, t in enumerate(plan.terms)]
    hits = index.postings.where(asked).groupBy("doc_id").agg(F.expr(f"{total} total"), *flags)
    # A document without any of the terms has no weight, so the universe isn't needed.
    good = hits.where("total > 0").where(cond).select("doc_id", "total")
    return good.join(index.docs.select("doc_id", "norm"), "doc_id", "left").selectExpr("doc_id", "if(norm > 0, total / norm, total) score")


def ranked_search(index: Index, query: str, offset: int = 0, limit: int = 50, yo_to_e: bool = True) -> DataFrame:
    """(doc_id, score, title, url) by falling score, then id; score to six digits."""
    top = page(scores(index, query, yo_to_e).orderBy(F.desc("score"), "doc_id"), offset, limit)
    return top.join(index.docs, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "title", "url").repartition(1).sortWithinPartitions(F.desc("score"), "doc_id")


def search(index: Index, query: str, offset: int = 0, limit: int = 50, yo_to_e: bool = True) -> DataFrame:
    """Boolean if the query holds an operator, else ranked."""
    return (boolean_search if is_boolean(query) else ranked_search)(index, query, offset, limit, yo_to_e)


def _plans(yo_to_e: bool):
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            plans = [Plan.of(q, yo_to_e) for q in texts]
            boolean = [is_boolean(q) for q in texts]
            times = [[{"term": t, "times": n} for t, n in {t: p.words.count(t) for t in p.terms}.items()] for p in plans]
            # A program of nothing but terms and AND asks for all of them.
            every = [len({t for t in p.code if t not in OPERATORS}) if p.code and all(t == "&&" or t not in OPERATORS for t in p.code) and p.code.count("&&") == sum(t not in OPERATORS for t in p.code) - 1 and set(p.terms) <= set(p.code) else None for p in plans]
            kind = pa.list_(pa.struct([("term", pa.string()), ("times", pa.int32())]))
            universe = [x and p.matches_empty for x, p in zip(boolean, plans)]
            columns = [b.column(0), pa.array(boolean), pa.array(universe), pa.array(every, pa.int32()), pa.array(times, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "boolean", "universe", "every", "terms"])

    return run


def _holds(yo_to_e: bool):
    def run(batches):
        programs: dict[str, list[str]] = {}
        for b in batches:
            keep = []
            for q, have in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code = programs.get(q)
                if code is None:
                    code = programs[q] = program(q, yo_to_e)
                keep.append(bool(evaluate(code, set(have).__contains__, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def batch_search(index: Index, queries: DataFrame, limit: int = 50, yo_to_e: bool = True) -> DataFrame:
    """(qid, place, doc_id, score, title, url) of a table (qid, query) of any size, each query as ``search``
    answers it: boolean ones by id and without a score, ranked ones by falling score; at most ``limit`` rows each.

    Equal queries are answered once. Queries become rows of their terms; one join with the postings and
    one aggregation by query and document serve all of them. A query that asks for all its terms is
    decided by their number, others by their program. A query that documents without any of its
    terms match (``!город``) ranges over all documents."""
    from wordmill.session import materialise

    asked = queries.select("qid", F.coalesce("query", F.lit("")).alias("query"))
    shape = "query string, boolean boolean, universe boolean, every int, terms array<struct<term:string,times:int>>"
    plans = materialise(asked.select("query").distinct().mapInArrow(_plans(yo_to_e), shape), "plans")
    terms = plans.select("query", F.explode("terms").alias("t")).select("query", "t.term", "t.times")
    words = index.words if index.words is not None else index.postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = terms.join(words.select("term", "df"), "term").withColumn("factor", log_of(F.lit(float(index.n_docs)) / F.col("df"), index.log_mode) * F.col("times"))
    weight = (1 + log_count("tf", index.log_mode)) * F.col("factor")
    hits = index.postings.join(terms, "term").groupBy("query", "doc_id").agg(F.sum(weight).alias("total"), F.collect_set("term").alias("have"))
    every = plans.where("universe").agg(F.collect_list("query").alias("queries"))  # as many as there are such queries
    ids = index.docs.select("doc_id").distinct()
    bare = ids.join(F.broadcast(every), F.lit(True)).select(F.explode("queries").alias("query"), "doc_id").join(hits.select("query", "doc_id"), ["query", "doc_id"], "left_anti")
    rows = hits.join(plans.select("query", "boolean", "every"), "query").where(F.col("boolean") | (F.col("total") > 0))
    simple = rows.where(F.col("every") == F.size("have")).select("query", "doc_id", "total", "boolean")
    rest = rows.where("every is null").select("query", "have", "doc_id", "total", "boolean")
    bare = bare.select("query", F.array().cast("array<string>").alias("have"), "doc_id", F.lit(0.0).alias("total"), F.lit(True).alias("boolean"))
    other = rest.unionByName(bare).mapInArrow(_holds(yo_to_e), "query string, have array<string>, doc_id long, total double, boolean boolean")
    rows = simple.unionByName(other.select("query", "doc_id", "total", "boolean")).join(index.docs.select("doc_id", "norm"), "doc_id")
    score = F.when(~F.col("boolean"), F.when(F.col("norm") > 0, F.col("total") / F.col("norm")).otherwise(F.col("total")))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    top = rows.select("query", "doc_id", score.alias("score")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    top = top.join(index.docs.select("doc_id", "title", "url"), "doc_id").join(asked, "query")
    return top.select("qid", "place", "doc_id", F.round("score", 6).alias("score"), "title", "url")
