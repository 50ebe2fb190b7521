"""Removal of repeated chunks of lines (operator 8); DataFrame functions only.

A text is split into lines, each line is hashed (MD5), and a hash that rolls over
the hashes of each line and the one before it chooses where chunks start: where
it is in the lowest ``spread``-th of its range.  Only the lines near by decide, so
an insertion or deletion elsewhere in a text doesn't shift the boundaries.  A line
of more than ``long_words`` words always is a chunk of its own, as boilerplate
often is one long line.  A chunk counts if it holds ``min_lines`` lines, or one
long line.

A boundary at either end of a shared passage depends on a line outside it, and a
short passage may hold no whole chunk.  So each pair of neighbouring lines counts
as well, and a run of repeated pairs is a repeated chunk of its own if its lines
hold more than ``long_words`` words together.

Chunks and pairs whose hash occurs again are candidates; grouping candidates by
hash and text compares their bytes.  The first occurrence, in the order (id, hash
of the text, line), stays; all others are removed.

Defined results: a null text stays null; a text that loses all its lines is
empty; rows that repeat an id and a text count as one occurrence and are
treated alike; an empty table gives an empty table; all input columns are
returned, n_chars (if there) holding the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.workspace import save

SPREAD = 3
MIN_LINES = 2
LONG_WORDS = 50


def _spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _is_long(line: Column, long_words: int) -> Column:
    """Whether a line has more than long_words words, counted by single spaces."""
    return F.when(F.length(line) > 2 * long_words, _spaces(line) >= long_words).otherwise(F.lit(False))


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(_spaces(line) + 1)


def _column(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row.

    A plain projection could be merged into the functions over array elements
    that read it, and then be computed again for each element; a generator of
    one row can't.
    """
    return docs.select("*", F.explode(F.array(value)).alias(name))


def _items(slim: DataFrame, spread: int, min_lines: int, long_words: int) -> DataFrame:
    """(id, th, items): of each text struct(whole, pos, n, hash) for chunks that count and for pairs of lines, n lines from pos."""
    lines, marks, starts = F.col("lines"), F.col("marks"), F.col("starts")
    below = F.lit(f"{(1 << 32) // spread:08x}")
    cut = _column(slim, "lines", F.split("text", "\n", -1))
    cut = _column(cut, "marks", F.transform(lines, lambda x: F.struct(F.md5(x).alias("h"), _is_long(x, long_words).alias("long"), (x == "").alias("empty"))))
    at = lambda i: F.element_at(marks, i)
    begins = lambda i: at(i)["long"] | at(i - 1)["long"] | (F.md5(F.concat(at(i - 1)["h"], at(i)["h"])) < below)
    # Each start, and one past the last line as an end.
    cut = _column(cut.drop("text", "lines").withColumn("size", F.size("marks")), "starts", F.filter(F.sequence(F.lit(1), F.col("size") + 1), lambda i: F.when((i == 1) | (i > F.col("size")), F.lit(True)).otherwise(begins(i))))
    span = lambda k: F.element_at(starts, k + 1) - F.element_at(starts, k)
    item = lambda whole, pos, n, h: F.struct(F.lit(whole).alias("whole"), pos.alias("pos"), n.alias("n"), h.alias("hash"))
    counts = F.filter(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: (span(k) >= min_lines) | at(F.element_at(starts, k))["long"])
    chunks = F.transform(counts, lambda k: item(True, F.element_at(starts, k), span(k), F.xxhash64(F.transform(F.slice(marks, F.element_at(starts, k), span(k)), lambda m: m["h"]))))
    inner = F.when(F.col("size") > 1, F.sequence(F.lit(1), F.col("size") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(F.filter(inner, lambda i: ~(at(i)["empty"] & at(i + 1)["empty"])), lambda i: item(False, i, F.lit(2), F.xxhash64(F.lit("pair"), at(i)["h"], at(i + 1)["h"])))
    return cut.select("id", "th", F.concat(chunks, pairs).alias("items"))


def repeated_lines(docs: DataFrame, spread: int = SPREAD, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, gone): of each text that repeats lines the struct(pos, n) of each stretch to remove; th is the hash of the text."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    items = save(_items(slim, spread, min_lines, long_words), "line-items")
    every = items.select("id", "th", F.explode("items").alias("i")).select("id", "th", "i.whole", "i.pos", "i.n", "i.hash")
    first = F.min(F.struct("id", "th", "pos")).alias("first")
    last = F.max(F.struct("id", "th", "pos")).alias("last")
    hashes = save(every.groupBy("hash").count().where("count > 1").select("hash"), "repeated")
    # The joins are the same at every size: a small input must not flip to a broadcast that a large one can't have.
    asked = every.join(hashes.hint("merge"), "hash").groupBy("id", "th").agg(F.collect_set(F.struct("whole", "pos", "n", "hash")).alias("items"))
    asked = save(asked, "candidates").select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), "items")
    met = slim.join(asked.hint("merge"), slim["id"].eqNullSafe(F.col("a_id")) & (slim["th"] == F.col("a_th")))
    met = _column(met.select("id", "th", "text", "items"), "lines", F.split("text", "\n", -1)).select("id", "th", "lines", F.explode("items").alias("i"))
    line = lambda k: F.element_at("lines", F.col("i.pos") + k)
    few = ~F.col("i.whole")
    met = met.select("id", "th", "i.whole", "i.pos", "i.n", "i.hash", F.array_join(F.slice("lines", F.col("i.pos"), F.col("i.n")), "\n").alias("chunk"), F.when(few, _words(line(0))).alias("words"), F.when(few, _words(line(1))).alias("next_words"))
    met = save(met.withColumn("digest", F.unhex(F.sha2("chunk", 256))), "candidate-lines")
    # Bytes are compared here; a digest stands for them in the join, so that texts are sent once.
    kept = save(met.groupBy("whole", "digest", "chunk").agg(first, last).where("first <> last").select("whole", "digest", "first"), "kept-lines")
    again = met.drop("chunk").join(kept.hint("merge"), ["whole", "digest"]).where(F.struct("id", "th", "pos") != F.col("first"))
    again = save(again.select("id", "th", "whole", "pos", "n", "words", "next_words").distinct(), "again")
    # Pairs that follow each other are one run; a text's pairs are few, so the window holds no more than a text.
    run = F.col("pos") - F.row_number().over(W.partitionBy("id", "th").orderBy("pos"))
    runs = again.where("not whole").withColumn("run", run).groupBy("id", "th", "run").agg(F.min("pos").alias("pos"), (F.count(F.lit(1)) + 1).cast("int").alias("n"), F.sum("words").alias("words"), F.max_by("next_words", "pos").alias("end"))
    gone = again.where("whole").select("id", "th", "pos", "n").unionAll(runs.where(F.col("words") + F.col("end") > long_words).select("id", "th", "pos", "n"))
    return save(gone.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("gone")), "removed")


def line_dedup(docs: DataFrame, spread: int = SPREAD, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, their texts without the repeated lines."""
    gone = repeated_lines(docs, spread, min_lines, long_words, id_col, text_col)
    by_doc = gone.select(F.col("id").alias("__ld_id"), F.col("th").alias("__ld_th"), F.col("gone").alias("__ld_gone")).hint("merge")
    keyed = docs.withColumn("__ld_hash", F.xxhash64(F.col(text_col)))
    joined = keyed.join(by_doc, keyed[id_col].eqNullSafe(by_doc["__ld_id"]) & (keyed["__ld_hash"] == by_doc["__ld_th"]) & keyed[text_col].isNotNull(), "left")
    inside = lambda i: F.exists("__ld_gone", lambda g: (i + 1 >= g["pos"]) & (i + 1 < g["pos"] + g["n"]))
    left = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~inside(i))
    out = _column(joined, "__ld_text", F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    kept = [F.col("__ld_text").alias(c) if c == text_col else F.length("__ld_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept)


def duckdb_sql(spread: int = SPREAD, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> str:
    """The same in DuckDB's SQL, for tables of unique ids."""
    return f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, md5(line) AS h, length(line) - length(replace(line, ' ', '')) AS spaces FROM lines
), begun AS (
  SELECT *, length(line) > {2 * long_words} AND spaces >= {long_words} AS long, CASE WHEN line = '' THEN 0 ELSE spaces + 1 END AS words FROM hashed
), cut AS (
  SELECT *, CASE WHEN i = 1 OR long OR lag(long) OVER w OR md5(lag(h) OVER w || h) < '{(1 << 32) // spread:08x}' THEN 1 ELSE 0 END AS b,
    lead(line) OVER w AS after, lead(words) OVER w AS after_words
  FROM begun WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM cut
), chunks AS (
  SELECT doc_id, min(i) AS i, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY doc_id, c HAVING count(*) >= {min_lines} OR bool_or(long)
), again_chunks AS (
  SELECT doc_id, i, n FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) > 1
), again_pairs AS (
  SELECT doc_id, i, words, after_words FROM cut WHERE after IS NOT NULL AND NOT (line = '' AND after = '')
  QUALIFY row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again_pairs
), runs AS (
  SELECT doc_id, min(i) AS i, count(*) + 1 AS n FROM islands GROUP BY doc_id, run HAVING sum(words) + arg_max(after_words, i) > {long_words}
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(generate_series(0, n - 1)) AS i FROM (SELECT * FROM again_chunks UNION ALL SELECT * FROM runs)
), left_over AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gi IS NULL), '') AS text
  FROM lines l LEFT JOIN (SELECT doc_id, i, i AS gi FROM gone) g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, l.text, d.lang, d.source, length(l.text)::BIGINT AS n_chars FROM documents d LEFT JOIN left_over l USING (doc_id)
"""
