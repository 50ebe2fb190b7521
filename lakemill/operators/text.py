"""Full-text search on DataFrames: analysis, query matching and BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions.strings import like

STOPWORDS = ("a", "an", "and", "of", "the", "to")
K1, B = 1.2, 0.75


def tokens(text, diacritics: bool = False, stopwords: bool = False) -> Column:
    """Terms of a text in order; diacritics=True folds Latin accents away."""
    x = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    if diacritics:
        accented = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
        x = F.translate(x, accented, "".join(unicodedata.normalize("NFD", c)[0] for c in accented))
    found = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if stopwords else found


def _starts(prefix: str):
    return lambda t: t.startswith(prefix)


def _equals(term: str):
    return lambda t: t == term


@dataclass
class Query:
    """Alternatives (OR) of terms, phrases, prefixes and exclusions (AND)."""

    clauses: list[dict[str, list]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Query:
        clauses: list[dict[str, list]] = [{"terms": [], "phrases": [], "prefixes": [], "not": []}]
        for phrase, word in re.findall(r'(-?"[^"]*")|(\S+)', text):
            negative = (phrase or word).startswith("-")
            if word == "OR":
                clauses.append({"terms": [], "phrases": [], "prefixes": [], "not": []})
                continue
            terms = re.findall(r"\w+", (phrase or word).lower())
            if not terms:
                continue
            if negative:
                clauses[-1]["not"].append(terms)
            elif phrase:
                clauses[-1]["phrases"].append(terms)
            elif word.endswith("*"):
                clauses[-1]["terms"] += terms[:-1]
                clauses[-1]["prefixes"].append(terms[-1])
            else:
                clauses[-1]["terms"] += terms
        return Query([c for c in clauses if any(c.values())])

    def terms(self) -> list[str]:
        """All wanted terms, for scoring."""
        return list(dict.fromkeys(t for c in self.clauses for t in [*c["terms"], *(x for p in c["phrases"] for x in p)]))

    def matches(self, found: Column) -> Column:
        """Whether an array of tokens matches."""
        joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
        phrase = lambda p: joined.contains(" " + " ".join(p) + " ")
        out = []
        for c in self.clauses:
            parts = [F.array_contains(found, t) for t in c["terms"]] + [phrase(p) for p in c["phrases"]]
            parts += [F.exists(found, _starts(x)) for x in c["prefixes"]]
            parts += [~phrase(p) for p in c["not"]]
            out.append(reduce(lambda a, b: a & b, parts))
        return reduce(lambda a, b: a | b, out) if out else F.lit(False)


def fulltext_match(text, query: str) -> Column:
    return Query.parse(query).matches(tokens(text))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, score) of the matching rows.

    One scan counts the few query terms of each row in place; N, the mean length
    and the document frequencies are one row of sums that is joined back.
    """
    q = Query.parse(query)
    terms = q.terms()
    counted = docs.select(F.col(id_col), tokens(text_col).alias("t")).select(
        id_col, F.size("t").cast("double").alias("len"), q.matches(F.col("t")).alias("hit"), *[F.size(F.filter("t", _equals(t))).cast("double").alias(f"tf{k}") for k, t in enumerate(terms)]
    )
    sums = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{k}") > 0).cast("double")).alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # One row of sums.
    return counted.where("hit").crossJoin(F.broadcast(sums)).select(id_col, score.alias("score"))


def bm25_top_k(docs: DataFrame, id_col: str, text_col: str, query: str, k: int) -> DataFrame:
    return bm25(docs, id_col, text_col, query).orderBy(F.desc("score"), id_col).limit(k)


def trigrams(text) -> Column:
    """Distinct upper-case trigrams, for an index table that narrows LIKE '%...%'.

    The text is cut into its characters once: substring looks for its place from
    the start, which takes the square of a text's length.
    """
    x = F.upper(F.col(text) if isinstance(text, str) else text)
    grams = lambda c: F.transform(F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))), lambda z, k: F.concat(c[k], c[k + 1], z))
    # The lambda's variable holds the characters; an expression in its place would be worked out anew for each.
    return F.when(F.length(x) >= 3, F.array_distinct(F.flatten(F.transform(F.array(F.split(x, "")), grams)))).otherwise(F.array().cast("array<string>"))


def required_trigrams(pattern: str) -> list[str]:
    """Upper-case trigrams that each text LIKE pattern holds."""
    parts = [p.upper() for p in re.split("[%_]", pattern)]
    return sorted({p[k : k + 3] for p in parts for k in range(len(p) - 2)})


def trigram_index(docs: DataFrame, id_col: str, text_col: str, grams: list[str] | None = None) -> DataFrame:
    """(gram, id): the index table, to be written with io.write_sorted by gram.

    With grams, only its rows of these: for one search that has no table to read.
    """
    found = trigrams(text_col) if grams is None else F.array_compact(F.array(*[F.when(F.upper(F.col(text_col)).contains(g), g) for g in grams]).cast("array<string>"))
    return docs.select(F.explode(found).alias("gram"), F.col(id_col))


def like_search(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """The rows whose text is LIKE pattern: those that hold all its trigrams, checked again.

    Only the pattern's grams are read of the index.  A pattern without three
    letters in a row has none, so all rows are checked.
    """
    grams = required_trigrams(pattern)
    if grams:
        held = index.where(F.col("gram").isin(grams)).groupBy(id_col).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        docs = docs.join(held.select(id_col), id_col, "left_semi")
    return docs.where(like(F.col(text_col), pattern))
