"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so it tells nothing of their order. Words that differ
by one letter have keys that differ by that letter's value, or by two letters' values where one replaces
another. Both sides of a join therefore take letters out of their keys: a word without one of its letters
has the key of the word that lacks it, and two words that differ in one letter have the same key without
it. Beside the key, rows carry the half of the word that the letter isn't in and, for an exchange, the
place of the letter, so that words of the same letters in quite another order don't meet. What is left is
verified letter by letter. All of it is joins and sums over the distinct words; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

#: The letters of words, and by what a text's hash picks the runs that lose one.
LETTERS, EVERY = "A-Za-zÀ-ÿ", 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are sums modulo this prime, so that the longest words have one.
MODULUS = (1 << 61) - 1
#: A form occurs at least so many times as often as its variant.
TIMES = 5


def words(docs: DataFrame, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """(word, n) of the words in whole texts that have ``shortest`` letters and occur ``fewest`` times or more.

    Words are maximal runs of letters with A-Z in lower case; where EVERY divides the CRC-32 of
    ``<doc_id>:<word>``, the word lacks a letter, as in a misspelt copy. Null texts have none, a null doc_id
    counts as an empty one, repeated rows count each.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    x = x.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    x = x.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    x = x.select(F.when(F.col("h") % EVERY == 0, gone).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return x.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _values(word: str) -> Column:
    """Each letter's fifth power, in order."""
    return F.expr(f"transform(split({word}, ''), c -> bigint(ascii(c)) * ascii(c) * ascii(c) * ascii(c) * ascii(c))")


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of words that differ in one inserted, deleted or replaced letter, both ways."""
    x = vocabulary.withColumns({"size": F.length("word"), "values": _values("word")})
    x = x.withColumn("key", F.expr(f"aggregate(values, 0L, (s, v) -> (s + v) % {MODULUS})"))
    less = x.select("word", "n", "size", "key", F.posexplode("values").alias("at", "value")).withColumn("rest", F.expr(f"pmod(key - value, {MODULUS})"))

    # An exchange: equal keys without the letter, which has the same place, and an equal half beside it.
    half = F.expr("CASE WHEN at < size div 2 THEN substring(word, size div 2 + 1) ELSE substring(word, 1, size div 2) END")
    one = less.select("word", "n", "size", "at", "rest", half.alias("half"))
    two = one.toDF("other", "other_n", "size", "at", "rest", "half")
    same = "substring(word, 1, at) = substring(other, 1, at) AND substring(word, at + 2) = substring(other, at + 2)"
    exchanged = one.join(two.hint("merge"), ["size", "at", "rest", "half"]).where(f"word < other AND {same}")

    # A removal: the longer word's key without the letter is the shorter word's; of a run of equal letters the first goes.
    first = "at = 0 OR substring(word, at, 1) <> substring(word, at + 1, 1)"
    left = less.where(first).withColumns({"size": F.col("size") - 1, "early": F.expr("at < (size - 1) div 2")})
    left = left.select("word", "n", "at", "size", "rest", "early", F.expr("CASE WHEN early THEN substring(word, size div 2 + 2) ELSE substring(word, 1, size div 2) END").alias("half"))
    parts = F.explode(F.array(
        F.struct(F.lit(True).alias("early"), F.expr("substring(word, size div 2 + 1)").alias("half")), F.struct(F.lit(False).alias("early"), F.expr("substring(word, 1, size div 2)").alias("half"))))
    short = x.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "size", F.col("key").alias("rest"), parts.alias("part"))
    short = short.select("other", "other_n", "size", "rest", "part.early", "part.half")
    removed = left.join(short.hint("merge"), ["size", "rest", "early", "half"]).where("concat(substring(word, 1, at), substring(word, at + 2)) = other")

    pairs = exchanged.select("word", "n", "other", "other_n").union(removed.select("word", "n", "other", "other_n"))
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def variants(spark: SparkSession, docs: DataFrame, shortest: int = 6, fewest: int = 5, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` (doc_id, text) and what they are variants of.

    A word's form is the word near it that occurs most often (of equals the first by code points), if that
    is ``times`` its own count or more, else null; its root is where following forms ends, itself if it has
    none. Words are those of ``words``. An empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "variants")
    vocabulary = scratch.keep(words(docs.select("doc_id", "text"), shortest, fewest), "words")
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("best")
    found = near(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best)
    x = vocabulary.join(found.hint("merge"), "word", "left").withColumn("best", F.when(F.col("best.other_n") >= times * F.col("n"), F.col("best")))
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("form"), F.col("best.other_n").alias("form_n"))
    x = scratch.keep(x, "forms")
    # Counts grow ``times`` with each form, so chains are short; each round doubles how far roots reach.
    roots, far = x.where("form is not null").select("word", F.col("form").alias("root")), True
    while far:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = scratch.keep(step, "roots")
        far = bool(step.where("moved").head(1))
        roots = step.select("word", "root")
    out = x.join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(shortest: int = 6, fewest: int = 5, times: int = TIMES) -> str:
    """DuckDB SQL over ``documents`` for the rows of ``variants``: CRC-32 byte by byte, neighbours by what they have in common without a letter."""
    return rf"""
    WITH RECURSIVE table_ AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(k))),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
    lows AS (SELECT doc, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS n FROM runs WHERE length(r) >= {shortest} GROUP BY ALL),
    hexes AS (SELECT r, n, hex(doc || ':' || r) AS x FROM lows),
    hashes AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexes, table_),
    cut AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM hashes),
    vocab AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {fewest}),
    spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
    holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM spots),
    removed AS (SELECT DISTINCT h.word, v.word AS other FROM holes h JOIN vocab v ON v.word = h.a || h.b),
    swapped AS (SELECT h.word, o.word AS other FROM holes h JOIN holes o ON h.a || '*' || h.b = o.a || '*' || o.b AND h.word <> o.word),
    pairs AS (SELECT * FROM swapped UNION ALL SELECT * FROM removed UNION ALL SELECT other, word FROM removed),
    near AS (SELECT p.word, v.word AS other, v.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, v.word) AS nth, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN vocab v ON v.word = p.other),
    forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {times} * v.n THEN other END AS form, CASE WHEN other_n >= {times} * v.n THEN other_n END AS form_n
        FROM vocab v LEFT JOIN (SELECT * FROM near WHERE nth = 1) b USING (word)),
    chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
