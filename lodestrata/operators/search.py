"""Full-text search: postings, boolean and phrase matching, BM25 ranking.

Postings have the columns field, term, doc_key, tf, positions, len. A query is a list of clauses;
each clause is one term, perhaps bound to a field, perhaps part of a phrase. A document's score is
the sum over clauses of the best field's BM25; document frequency counts the documents that match
the clause over its fields; the average length is a constant (100) unless given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import comparable
from lodestrata.functions.text import terms, terms_of

#: Fixed values of the ranking formula.
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 100.0


@dataclass(frozen=True)
class Clause:
    term: str
    field: str | None = None
    phrase: int | None = None


def parse_query(text: str | None) -> list[Clause]:
    """Quoted parts are phrases, ``field:`` binds what follows up to the next blank or quote."""
    clauses, phrases = [], 0
    for quoted, bare in re.findall(r'"([^"]+)"|(\S+)', text or ""):
        raw = quoted or bare
        field, colon, rest = raw.partition(":")
        bound = field.lower() if colon and field else None
        clauses += [Clause(term, bound, phrases if quoted else None) for term in terms_of(rest if bound else raw)]
        phrases += bool(quoted)
    return clauses


def field_alias(path: str) -> str:
    """The name a field is addressed by in queries: its path below ``value``, lower-cased."""
    return ".".join(p for i, p in enumerate(path.split(".")) if p and not (i == 0 and p.lower() == "value")).lower()


def field_texts(state: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """doc_key, field, text (and ``keep``) of every indexed field; an empty path takes the whole value text."""
    paths = {field_alias(f): ".".join(p for i, p in enumerate(f.split(".")) if not (i == 0 and p.lower() == "value")) for f in fields}
    texts = F.array(*[F.struct(F.lit(alias).alias("field"), comparable(F.col("row_value"), path).alias("text")) for alias, path in paths.items()])
    return state.select(F.col("row_key").alias("doc_key"), *(keep or []), F.inline(texts)).where(F.col("text").isNotNull())


#: The words of a text sorted with their positions, where each term begins, and the term with its positions.
_GROUPED = """
    transform(array(array_sort(transform(words, (w, i) -> named_struct('w', w, 'i', i)))), s ->
      transform(array(filter(transform(s, (x, k) -> if(k = 0 OR s[k - 1].w <> x.w, k, null)), k -> k IS NOT NULL)), b ->
        transform(b, (k, n) -> named_struct('term', s[k].w, 'positions',
          transform(slice(s, k + 1, coalesce(get(b, n + 1), size(s)) - k), x -> x.i))))[0])[0]"""


def postings(texts: DataFrame, only: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """field, term, doc_key, tf, positions, len (and ``keep``) of ``texts`` (doc_key, field, text).

    ``texts`` has one row per document and field, so all postings of a document are made in its own
    row and nothing is shuffled. With ``only`` those of a few terms are made.
    """
    keep = keep or []
    words = texts.select("doc_key", "field", *keep, terms(F.col("text")).alias("words")).withColumn("len", F.size("words"))
    if only is not None:
        held = [f"named_struct('term', {_quoted(t)}, 'positions', filter(transform(words, (w, i) -> if(w = {_quoted(t)}, i, null)), i -> i IS NOT NULL))" for t in only]
        found = words.select("doc_key", "field", *keep, "len", F.expr(f"inline(filter(array({', '.join(held)}), p -> size(p.positions) > 0))"))
    else:
        found = words.select("doc_key", "field", *keep, "len", F.expr(f"inline({_GROUPED})"))
    return found.select("field", "term", "doc_key", *keep, F.size("positions").alias("tf"), "positions", "len")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_postings(found: DataFrame, target: str) -> None:
    """Postings as Parquet sorted by term within range partitions, so a query reads few row groups."""
    sorted_ = found.repartitionByRange("term", "doc_key").sortWithinPartitions("term", "field", "doc_key")
    sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(target)


def idf(total: float, df: str):
    """Column over the number of documents that match a clause."""
    return F.log(1 + (total - F.col(df) + 0.5) / (F.col(df) + 0.5))


def weight(average_length: float = AVERAGE_LENGTH):
    """Column over tf and len: BM25 without the inverse document frequency."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average_length))


def matches(found: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Postings of the query's terms with the clause number they serve."""
    wanted = F.array(*[
        F.struct(F.lit(i).alias("clause"), F.lit(c.term).alias("want"), F.lit(c.field).cast("string").alias("bound")) for i, c in enumerate(clauses)
    ])
    hit = found.where(F.col("term").isin(sorted({c.term for c in clauses}))).select("*", F.inline(wanted))
    return hit.where((F.col("term") == F.col("want")) & F.coalesce(F.col("field") == F.col("bound"), F.lit(True))).drop("want", "bound")


def has_phrase(numbers: list[int]) -> Column:
    """Whether ``held`` (array of field, clause, positions) has the clauses at consecutive positions of one field."""

    def of(clause: int, field: Column) -> Column:
        mine = F.filter("held", lambda h: (h["clause"] == clause) & (h["field"] == field))
        return F.coalesce(F.get(mine, F.lit(0))["positions"], F.array().cast("array<int>"))

    def whole(field: Column) -> Column:
        def follows(at: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.array_contains(of(i, field), at + k) for k, i in enumerate(numbers)])

        return F.exists(of(numbers[0], field), follows)

    return F.exists(F.array_distinct(F.transform("held", lambda h: h["field"])), whole)


def rank(found: DataFrame, query: str, total: int, operator: str = "or", average_length: float = AVERAGE_LENGTH) -> DataFrame:
    """doc_key, score of every match; empty for a query without terms.

    The postings of the query's terms meet once per document (a few per clause and field); the best
    field, phrases and the score come from that one row. Only the number of documents per clause is
    counted beside it, from the same shuffled rows.
    """
    clauses = parse_query(query)
    if not clauses:
        return found.select("doc_key", F.lit(0.0).alias("score")).limit(0)
    phrases = [[i for i, c in enumerate(clauses) if c.phrase == p] for p in sorted({c.phrase for c in clauses if c.phrase is not None})]
    hit = matches(found, clauses)
    columns = [F.max(F.when(F.col("clause") == i, weight(average_length))).alias(f"w{i}") for i in range(len(clauses))]
    if phrases:
        columns.append(F.collect_list(F.when(F.col("clause").isin(sorted(sum(phrases, []))), F.struct("field", "clause", "positions"))).alias("held"))
    docs = hit.groupBy("doc_key").agg(*columns)
    # The inverse document frequency is one positive factor per clause, so the best field is known without it.
    frequency = docs.agg(*[F.count(f"w{i}").alias(f"df{i}") for i in range(len(clauses))])
    one = F.lit(1).alias("one")
    scored = docs.select("*", one).join(F.broadcast(frequency.select("*", one)), "one")  # one row of counts
    parts = [F.coalesce(F.col(f"w{i}") * idf(float(max(1, total)), f"df{i}"), F.lit(0.0)) for i in range(len(clauses))]
    for numbers in phrases:
        scored = scored.where(has_phrase(numbers))
    if operator.lower() == "and":
        scored = scored.where(reduce(lambda a, b: a & b, [F.col(f"w{i}").isNotNull() for i in range(len(clauses))]))
    return scored.select("doc_key", reduce(lambda a, b: a + b, parts).alias("score"))


def page(ranked: DataFrame, limit: int = 20, offset: int = 0, most_rows: int | None = 1000, most_offset: int | None = 10_000) -> DataFrame:
    """One page, best score first, ties by key; offsets and limits are free if their bounds are None."""
    best = ranked.orderBy(F.desc("score"), "doc_key")
    offset = max(0, offset if most_offset is None else min(offset, most_offset))
    return (best.offset(offset) if offset else best).limit(max(1, limit if most_rows is None else min(limit, most_rows)))


def document_frequencies(found: DataFrame) -> DataFrame:
    """field, term, df, total_tf."""
    return found.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def average_lengths(texts: DataFrame) -> DataFrame:
    """field, avg_len, n_docs, for ranking by the corpus average."""
    return texts.select("field", F.size(terms(F.col("text"))).alias("len")).groupBy("field").agg(F.avg("len").alias("avg_len"), F.count("*").alias("n_docs"))

