"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines that occur once can be in no repeated run, so only lines that recur get ids; ids are ranks, and
prefix doubling ranks blocks of 2, 4, 8 ... lines from pairs of ranks, each round one sort of the
distinct recurring pairs; a suffix's rank in round k is its place by its first 2^k lines.

Runs are the longest-common-prefix intervals of that order.  Two suffixes have at least m lines in
common if and only if their first m lines are named alike, by the ranks of the two blocks of 2^k
lines (2^k <= m < 2^(k+1)) that cover them; so the suffixes that share a name are the interval of
depth m, and no order beyond depth m can part or join them.  A run matters from `min_words` words
on, and m is the least number of lines that has them, at most min_words; so the doubling ends there.
Every longer repeated run is the union of such shortest runs that begin or end at its lines, and
lies in their intervals: `repeated_runs` puts them together again into maximal runs.  In each
interval the first copy (by doc_id, then place) stays and the lines of later ones are deleted,
unless a copy overlaps the first.

Only hashes, ranks and places are shuffled; texts move once, to meet their deleted lines.  What is
summed up by a key is written before it is joined by that key, so that Spark can split the frequent
ones: a line, or a passage, may stand in a third of all texts.

Defined results: lines are parted by line feeds; blank lines take no part and stay; null and empty
texts stay as they are; rows that agree in id and text count as one copy and come back alike; rows
without an id come after all others; an empty table gives no rows; other columns are kept by
`deduplicated`, but for one that has the name it gives to the deleted places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, table

MIN_WORDS = 50
SPACE = " \t\r\x0b\x0c"
DOC = ["doc_id", "_text"]
LAST = (1 << 63) - 1  #: stands for the id of rows that have none
INTERVAL = ["k", "m", "a", "b"]


def with_names(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """Groups that occur more than once, with their ranks in sorted order."""
    recurring = groups.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return cut(recurring.orderBy(*by).withColumn(name, F.monotonically_increasing_id()))


def doc_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """An id that is never null, and a hash of the text that tells whether it was."""
    own = F.col(id_col).cast("long")
    return F.coalesce(own, F.lit(LAST)), F.xxhash64(text_col, own.isNull())


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text (the text's hash), ord (among its lines that aren't blank), line, words and two hashes of every such line."""
    trimmed = lambda x: F.btrim(x, F.lit(SPACE))
    entry = lambda x, i: F.struct(i.alias("line"), F.when(trimmed(x) == "", 0).otherwise(F.size(F.split(trimmed(x), f"[{SPACE}]+"))).alias("words"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), entry), lambda s: s["words"] > 0)
    own, text = doc_key(id_col, text_col)
    return docs.where(F.length(text_col) > 0).select(own.alias("doc_id"), text.alias("_text"), F.posexplode(lines).alias("ord", "_l")).select(*DOC, "ord", "_l.*")


def first_run(listed: Column, step: int, min_words: int) -> Column:
    """How many of the listed lines, in consecutive places, it takes to reach min_words; 0 if they don't."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(False).alias("done"), F.lit(None).cast("int").alias("last"))

    def add(acc: Column, x: Column) -> Column:
        goes_on = ~acc["done"] & (acc["last"].isNull() | (x["ord"] == acc["last"] + step))
        words = acc["words"] + x["words"]
        return F.when(
            goes_on, F.struct(words.alias("words"), (acc["n"] + 1).alias("n"), (words >= min_words).alias("done"), x["ord"].alias("last"))
        ).otherwise(F.struct(acc["words"].alias("words"), acc["n"].alias("n"), acc["done"].alias("done"), F.lit(-(1 << 30)).alias("last")))

    return F.aggregate(listed, start, add, lambda acc: F.when(acc["done"], acc["n"]).otherwise(0))


def shortest_runs(level: DataFrame, min_words: int) -> DataFrame:
    """doc, start, m and lines of the shortest runs of recurring lines with min_words words that begin or end at each line."""
    in_doc = W.partitionBy(*DOC).orderBy("ord")
    entry = F.struct("ord", "words", "line")
    ahead = F.collect_list(entry).over(in_doc.rangeBetween(0, min_words - 1))
    behind = F.collect_list(entry).over(in_doc.rangeBetween(-(min_words - 1), 0))
    both = level.select(*DOC, "ord", ahead.alias("_ahead"), F.reverse(behind).alias("_behind"))
    taken = lambda c, step: F.slice(c, F.lit(1), first_run(F.col(c), step, min_words))
    runs = both.select(*DOC, F.explode(F.array(taken("_ahead", 1), F.reverse(taken("_behind", -1)))).alias("_run")).where(F.size("_run") > 0)
    return runs.select(*DOC, F.col("_run")[0]["ord"].alias("start"), F.size("_run").alias("m"), F.transform("_run", lambda x: x["line"]).alias("lines")).dropDuplicates([*DOC, "start", "m"])


def run_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The copies of the shortest repeated runs: their interval (k, m, a, b), doc, start and lines."""
    every = cut(line_rows(docs, id_col, text_col))
    names = with_names(every, ["h1", "h2"], "rank")
    level = cut(every.join(names, ["h1", "h2"]).select(*DOC, "ord", "line", "words", "rank").dropDuplicates([*DOC, "ord"]))
    runs = cut(shortest_runs(level, min_words).withColumn("k", F.length(F.bin("m")) - 1))
    wanted = {r["k"] for r in runs.select("k").distinct().collect()}  # few: powers of two up to min_words

    in_doc = W.partitionBy(*DOC).orderBy("ord")
    level = level.select(*DOC, "ord", "rank")
    parts = []
    for k in range(max(wanted, default=0) + 1):  # no run needs longer blocks
        size = 1 << k
        if k:
            ahead_rank = F.first("rank").over(in_doc.rangeBetween(size // 2, size // 2))
            pairs = cut(level.withColumn("_then", ahead_rank).where("_then is not null").select(*DOC, "ord", F.col("rank").alias("_one"), "_then"))
            level = cut(pairs.join(with_names(pairs, ["_one", "_then"], "rank"), ["_one", "_then"]).select(*DOC, "ord", "rank"))
        if k in wanted or not parts:
            at = lambda place, name: level.select(*DOC, F.col("ord").alias(place), F.col("rank").alias(name))  # noqa: E731, B023
            named = runs.where(F.col("k") == k).withColumn("_end", F.col("start") + F.col("m") - size).join(at("start", "a"), [*DOC, "start"])
            named = named.join(at("_end", "b"), [*DOC, "_end"]) if k else named.withColumn("b", F.col("a"))
            parts.append(cut(named.select(*INTERVAL, *DOC, "start", "lines")))
        release(docs.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the copies of each run those that are neither the first nor overlap it, with the first one's doc and start (_first)."""
    found = run_copies(docs, min_words, id_col, text_col)
    firsts = cut(found.groupBy(*INTERVAL).agg(F.count("*").alias("_n"), F.min(F.struct(*DOC, "start")).alias("_first")).where("_n > 1").drop("_n"))
    same = (F.col("doc_id") == F.col("_first.doc_id")) & (F.col("_text") == F.col("_first._text"))
    return found.join(firsts, INTERVAL).where(~same | (F.col("start") >= F.col("_first.start") + F.col("m")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal runs that repeat an earlier text: doc_id, first_line and last_line, from_doc, and n_lines, counted without blank ones.

    Shortest runs that follow one another in both texts are one run.
    """
    rows = later_copies(docs, min_words, id_col, text_col).select(*DOC, F.col("_first.doc_id").alias("from_doc"), F.col("_first._text").alias("_from"), (F.col("start") - F.col("_first.start")).alias("_shift"), "start", (F.col("start") + F.col("m")).alias("_stop"), "lines")
    shift = [*DOC, "from_doc", "_from", "_shift"]
    in_order = W.partitionBy(*shift).orderBy("start", "_stop")
    before = F.max("_stop").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    parted = rows.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = parted.withColumn("_run", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy(*shift, "_run").agg(F.min(F.element_at("lines", 1)).alias("first_line"), F.max(F.element_at("lines", -1)).alias("last_line"), (F.max("_stop") - F.min("start")).alias("n_lines"))
    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return merged.select(known("doc_id").alias("doc_id"), "first_line", "last_line", known("from_doc").alias("from_doc"), "n_lines")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text and the sorted places of the lines to delete, for each text that has any."""
    gone = later_copies(docs, min_words, id_col, text_col).select(*DOC, F.explode("lines").alias("line")).distinct()
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("deleted"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", mark: str = "deleted") -> DataFrame:
    """docs with later copies of repeated runs cut out of the text, and in the column `mark` the places of the lines cut (null if none)."""
    gone = cut(deletions(docs, min_words, id_col, text_col))
    columns = [c for c in docs.columns if c != mark]
    own, hashed = doc_key(id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), own.alias("_id"), hashed.alias("_hash"))
    joined = rows.join(gone, (rows["_id"] == gone["doc_id"]) & (rows["_hash"] == gone["_text"]), "left").select("_row", F.col("deleted").alias("_gone"))
    text = F.col(f"_row.`{text_col}`")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    new = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns), F.col("_gone").alias(mark))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long"))
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.array_join("deleted", ","), F.lit("")).alias("deleted"), "text")


OP8_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), every_line AS (
  SELECT doc_id, unnest(parts) AS txt, generate_subscripts(parts, 1) - 1 AS line FROM split
), counted AS (
  SELECT *, len(regexp_extract_all(txt, '[^ \t\r\x0b\x0c]+')) AS words FROM every_line
), solid AS (
  SELECT doc_id, txt, line, words, row_number() OVER w AS ord, sum(words) OVER w AS upto
  FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), listed AS (
  SELECT doc_id, list(txt ORDER BY ord) AS txts, list(line ORDER BY ord) AS places FROM solid GROUP BY doc_id
), runs AS (
  SELECT DISTINCT a.doc_id, a.ord AS start, b.ord AS stop
  FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.ord >= a.ord AND b.ord < a.ord + {MIN_WORDS}
  WHERE b.upto - a.upto + a.words >= {MIN_WORDS}
    AND (b.upto - a.upto + a.words - b.words < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})
), texts AS (
  SELECT r.*, array_to_string(list_slice(l.txts, start, stop), chr(10)) AS body, list_slice(l.places, start, stop) AS places
  FROM runs r JOIN listed l USING (doc_id)
), first_copy AS (
  SELECT *, first_value(doc_id) OVER w AS doc0, first_value(start) OVER w AS start0, first_value(stop) OVER w AS stop0
  FROM texts WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)
), gone AS (
  SELECT DISTINCT doc_id, unnest(places) AS line FROM first_copy WHERE doc_id <> doc0 OR start > stop0
), result AS (
  SELECT e.doc_id, count(g.line) AS n_deleted,
    coalesce(string_agg(g.line, ',' ORDER BY g.line) FILTER (g.line IS NOT NULL), '') AS deleted,
    coalesce(string_agg(e.txt, chr(10) ORDER BY e.line) FILTER (g.line IS NULL), '') AS text
  FROM every_line e LEFT JOIN gone g USING (doc_id, line) GROUP BY e.doc_id
)
SELECT r.doc_id, CASE WHEN s.text = '' THEN 0 ELSE len(s.parts) END::BIGINT AS n_lines, r.n_deleted, r.deleted, r.text
FROM result r JOIN split s USING (doc_id)
"""
