"""Mixing sources to target weights, in DataFrame and SQL functions only.

Each source's words, its documents one after another, are packed into blocks of fixed length. A source
gets as many block slots as its target asks for. How many of them each output shard gets is drawn first:
every slot falls on a shard by itself, so the source counts of a shard are multinomial, given that the
sources' totals meet their targets. A source's slots are then numbered shard by shard by these counts.
Slot j of a source takes the block that a pseudorandom permutation of the source's blocks (one for each pass over
them) has at j, and the slots are joined with the blocks by that index. The permutation is the
swap-or-not shuffle of Hoang, Morris and Rogaway: it permutes any range without tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, rounds of the permutation, slots in an output shard, and position buckets of a source.
BLOCK, ROUNDS, SHARD, BUCKETS = 128, 16, 4096, 1024
#: Slots that one row unfolds into, so that a large source's slots spread over tasks.
RUN = 16384
PRIME = 2147483647


def draw(m: str, r: str, s: str) -> str:
    """SQL for a pseudorandom number below PRIME from three longs; it reads alike in Spark and DuckDB."""
    z = f"(((({m}) % {PRIME} + ({r}) * 1000003 + ({s}) * 7368787) % {PRIME}) * 48271 % {PRIME})"
    return f"(({z} * {z} + {z} + ({r}) * 69621) % {PRIME})"


def targets(sizes: DataFrame, percent: int, weights: tuple[int, ...], repeat: int) -> DataFrame:
    """(skey, source_size, rank, weight, target) of each source (skey, source_size).

    Sources by code point, null last, take the weights in turn. Targets share ``percent`` of all words by
    weight; one above ``repeat`` times its source's size stops there and the excess is shared again. In
    order of cap over weight, the first source that stays below its cap fixes the level of all after it.
    One row for each source meets in one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("skey") == "", "skey")
    x = sizes.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("weight", w)
    x = x.withColumn("cap", F.col("source_size") * repeat)
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"all_words": F.sum("source_size").over(every), "all_weights": F.sum("weight").over(every),
                       "caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    x = x.withColumn("level", (F.col("all_words") * percent / 100.0 - F.col("caps")) / (F.col("all_weights") - F.col("gone")))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)
    x = x.withColumn("level", first["level"])
    goal = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return x.select("skey", "source_size", "rank", "weight", goal.alias("target"))


def _unfolded(sources: DataFrame, parts: int) -> DataFrame:
    """(skey, rank, n_blocks, n_slots, shards, run, upto): the slots of each source in runs of RUN."""
    x = sources.where("n_slots > 0").select("skey", "rank", "n_blocks", "n_slots", "shards", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {RUN})")).alias("run"))
    # A number of partitions keeps Spark from unfolding these few rows in one task.
    return x.withColumn("upto", F.expr(f"least(n_slots, (run + 1) * {RUN}) - 1")).repartition(parts, "skey", "run")


def shard_counts(sources: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """(skey, shard, n, start): multinomial slot counts of each output shard, and the slots of its source before it.

    ``sources`` has skey, rank, n_blocks, n_slots and shards.
    """
    x = _unfolded(sources, parts).withColumn("key", F.expr(f"rank * 64 + {seed} * 4099"))
    shard = F.explode(F.expr(f"transform(sequence(run * {RUN}, upto), j -> {draw('j', '31', 'key')} % shards)"))
    counts = x.select("skey", shard.alias("shard")).groupBy("skey", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(sources: DataFrame, counts: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """(skey, shard, block, pass) for every slot of ``sources``, numbered by their ``shard_counts``."""
    keys = sources.select("skey", "rank", "n_blocks")
    # A shard has about SHARD slots, whatever the corpus.
    x = counts.join(keys, "skey").repartition(parts, "skey", "shard")
    x = x.select("skey", "shard", "rank", "n_blocks", F.explode(F.expr("sequence(start div n_blocks, (start + n - 1) div n_blocks)")).alias("pass"), "start", "n")
    x = x.withColumns({"lo": F.expr("greatest(start - pass * n_blocks, 0)"), "hi": F.expr("least(start + n - pass * n_blocks, n_blocks) - 1"), "key": F.expr(f"rank * 64 + pass + {seed} * 4099")})
    rounds = f"transform(sequence(1, {ROUNDS}), r -> named_struct('k', {draw('r', '17', 'key')} % n_blocks, 'a', {draw('r', '23', 'key')} + 1, 'b', {draw('r', '29', 'key')}))"
    step = "CASE WHEN (greatest(x, pmod(q.k - x, n_blocks)) % {0} * q.a + q.b) % {0} div 1024 % 2 = 1 THEN pmod(q.k - x, n_blocks) ELSE x END".format(PRIME)
    drawn = f"transform(sequence(lo, hi), j -> aggregate(rounds, j, (x, q) -> {step}))"
    return x.withColumn("rounds", F.expr(rounds)).select("skey", "shard", F.explode(F.expr(drawn)).alias("block"), "pass")


def placed(spark: SparkSession, docs: DataFrame, scratch: Scratch, percent: int, weights: tuple[int, ...], repeat: int, seed: int):
    """Documents at their place in their source's words, and the slots' block counts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    bucket = F.expr(f"{draw('abs(coalesce(doc_id, 0) % 2147483647)', '7', '0')} % {BUCKETS}")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"), size.alias("size"), *[c for c in docs.columns if c == "again"])
    rows = scratch.keep(rows.withColumn("bucket", bucket), "sizes")
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    sums = scratch.keep(sums, "buckets")
    goals = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")), percent, weights, repeat)
    n_blocks = F.ceil(F.col("source_size") / F.lit(BLOCK))
    goals = goals.withColumn("n_blocks", n_blocks)
    n_slots = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5), F.col("n_blocks") * repeat)).otherwise(0)
    goals = goals.withColumn("n_slots", n_slots.cast("long"))
    goals = goals.withColumn("shards", F.ceil((F.sum("n_slots").over(Window.partitionBy(F.lit(1))) + 1) / F.lit(SHARD)))
    goals = scratch.keep(goals, "targets")

    up = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("start"))
    starts = scratch.keep(starts.join(goals.select("skey", "source_size", "target"), "skey"), "starts")
    own = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size")
    x = rows.withColumns({"nth": F.row_number().over(own), "upto": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    x = x.join(starts, ["skey", "bucket"]).withColumn("at", F.col("start") + F.col("upto") - F.col("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.keep(shard_counts(goals, parts, seed), "shards")
    return x.drop("start", "upto"), slots(goals, counts, parts, seed)


def pieces(rows: DataFrame) -> DataFrame:
    """One row for each block that a document reaches into, with the words of it there; one without block if none."""
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}")))
    x = rows.select("*", F.explode_outer(span).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * BLOCK), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return x.withColumns({"first": lo - F.col("at"), "words": hi - lo})


def mix_counts(spark: SparkSession, docs: DataFrame, percent: int = 150, weights: tuple[int, ...] = (3, 1, 2), repeat: int = 2, seed: int = 0) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken, shards.

    ``shards`` is the number of output shards that have a block with words of the document.

    ``docs`` has doc_id, text and source. One row for each row of it: null texts have size 0, null sources
    are a source of their own, rows with equal or null doc_id each have a place of their own. No document
    is taken more than ``repeat`` times. The same rows give the same mix in every run. Empty tables give
    empty results; further columns are ignored.
    """
    scratch = Scratch(spark, "mixing")
    rows, drawn = placed(spark, docs.select("doc_id", "text", "source"), scratch, percent, weights, repeat, seed)
    # Spark takes unfolded slots for as few as the rows they come from, and would broadcast them.
    times = drawn.groupBy("skey", "block").agg(F.count("*").alias("times"), F.collect_set("shard").alias("in")).hint("merge")
    key = ["skey", "bucket", "nth", "doc_id", "size", "source_size", "target"]
    x = pieces(rows).join(times, ["skey", "block"], "left")
    x = x.groupBy(*key).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"), F.array_distinct(F.flatten(F.collect_list("in"))).alias("in"))
    return x.select("doc_id", "size", "source_size", "target", "taken", F.size("in").cast("long").alias("shards"))


def mix_documents(spark: SparkSession, docs: DataFrame, percent: int = 150, weights: tuple[int, ...] = (3, 1, 2), repeat: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row for each pass that takes words of a document.

    A pass that takes all of a document has its text as it is, another one the words of the taken blocks,
    joined by single spaces; n_chars, where present, follows. Cases are those of ``mix_counts``; documents
    without words are not part of a mix.
    """
    scratch = Scratch(spark, "mixing")
    # Rows that are alike in doc_id, text and source are told apart by a number; which has which is all one.
    mark = F.xxhash64("doc_id", "text", "source")
    # The row as it is stays in one struct, so that no column of it can clash with those added here.
    again = Window.partitionBy("mark").orderBy("row.doc_id")
    docs_on = docs.select(mark.alias("mark"), F.struct("*").alias("row")).withColumn("twin", F.row_number().over(again))
    slim = docs.select("doc_id", "text", "source", mark.alias("again"))
    rows, drawn = placed(spark, slim, scratch, percent, weights, repeat, seed)
    x = pieces(rows).where("block is not null").join(drawn.select("skey", "block", "pass").hint("merge"), ["skey", "block"])
    x = x.groupBy("skey", "bucket", "nth", "again", "size", "pass").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("taken"))
    x = x.groupBy("skey", "bucket", "nth", "again").agg(F.collect_list(F.struct("pass", "size", "taken", "parts")).alias("passes"))
    x = x.select(F.col("again").alias("mark"), "passes", F.row_number().over(Window.partitionBy("again").orderBy("skey", "bucket", "nth")).alias("twin"))
    y = docs_on.join(x.hint("merge"), ["mark", "twin"]).select("row", F.explode("passes").alias("take"))
    words = F.expr(f"transform(take.parts, p -> concat_ws(' ', slice(regexp_extract_all(row.text, '{WORD.replace(chr(92), chr(92) * 2)}', 0), cast(p.first + 1 as int), cast(p.words as int))))")
    text = F.when(F.col("take.taken") == F.col("take.size"), F.col("row.text")).otherwise(F.concat_ws(" ", words))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return y.select(*[v.alias(c) for c, v in own.items()])


def mix_blocks(spark: SparkSession, docs: DataFrame, percent: int = 150, weights: tuple[int, ...] = (3, 1, 2), repeat: int = 2, seed: int = 0) -> DataFrame:
    """The output shards of the mix, a row for each slot: shard, place, source, block, pass, n_words, doc_ids, text.

    A shard's slots stand in a pseudorandom order of all sources, at places from 0. A block's text is its words
    joined by single spaces, doc_ids their documents in order (null where the row has none); a source's last
    block may be shorter than BLOCK. Each pass over a source has a block once. A null source stays null. Cases
    are those of ``mix_counts``; very long texts are split into words once; ties and repeated rows have a place each.
    """
    scratch = Scratch(spark, "mixing")
    mark = F.xxhash64("doc_id", "text", "source").alias("again")
    slim = docs.select("doc_id", "text", "source", mark)
    rows, drawn = placed(spark, slim, scratch, percent, weights, repeat, seed)
    drawn = scratch.keep(drawn, "drawn")
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("again").orderBy("skey", "bucket", "nth")))
    wanted = drawn.select("skey", "block").distinct().hint("merge")
    x = pieces(rows).where("block is not null").join(wanted, ["skey", "block"], "left_semi")
    x = x.groupBy("again", "twin").agg(F.collect_list(F.struct("skey", "block", "at", "first", "words")).alias("parts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark).withColumn("twin", F.row_number().over(Window.partitionBy("again").orderBy("doc_id")))
    # Unfolding an array of one keeps Spark from splitting the text again for each part.
    words = F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("words")
    x = texts.join(x.hint("merge"), ["again", "twin"]).select("doc_id", "parts", words)
    cut = "transform(parts, p -> named_struct('skey', p.skey, 'block', p.block, 'at', p.at, 'n', p.words, 'text', concat_ws(' ', slice(words, cast(p.first + 1 as int), cast(p.words as int)))))"
    x = x.select("doc_id", F.explode(F.expr(cut)).alias("p"))
    # Words of a source have one document each, so a block has at most BLOCK parts.
    x = x.groupBy(F.col("p.skey").alias("skey"), F.col("p.block").alias("block")).agg(
        F.sum("p.n").alias("n_words"), F.array_sort(F.collect_list(F.struct("p.at", "doc_id", "p.text"))).alias("parts"))
    x = drawn.join(x.hint("merge"), ["skey", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("skey", "block", "pass", F.lit(seed)), "skey", "block", "pass")
    return x.select(
        "shard", (F.row_number().over(order) - 1).alias("place"), F.when(F.col("skey") != "", F.expr("substring(skey, 2)")).alias("source"), "block", "pass", "n_words",
        F.col("parts.doc_id").alias("doc_ids"), F.concat_ws(" ", F.col("parts.text")).alias("text"))


def counts_sql(percent: int = 150, weights: tuple[int, ...] = (3, 1, 2), repeat: int = 2, seed: int = 0) -> str:
    """DuckDB SQL over ``documents`` for the rows of ``mix_counts``."""
    other = f"((({draw('r', '17', 'key')} % n_blocks) - x + n_blocks) % n_blocks)"
    swap = (f"CASE WHEN (greatest(x, {other}) % {PRIME} * ({draw('r', '23', 'key')} + 1) + {draw('r', '29', 'key')}) % {PRIME} // 1024 % 2 = 1 "
            f"THEN {other} ELSE x END")
    return rf"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS skey,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
    r AS (SELECT *, {draw('abs(coalesce(doc_id, 0) % 2147483647)', '7', '0')} % {BUCKETS} AS bucket FROM d),
    p AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY bucket, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS spot,
        row_number() OVER () AS nth FROM r),
    s AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey = '', skey) AS rank FROM d GROUP BY skey),
    w AS (SELECT *, ([{', '.join(map(str, weights))}])[((rank - 1) % {len(weights)}) + 1] AS weight, source_size * {repeat} AS cap FROM s),
    c AS (SELECT *, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights,
        coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS gone FROM w
        WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, (all_words::DOUBLE * {percent} / 100.0::DOUBLE - caps::DOUBLE) / (all_weights - gone)::DOUBLE AS own FROM c),
    v AS (SELECT *, first_value(CASE WHEN own * weight <= cap THEN own END IGNORE NULLS) OVER
        (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM l),
    t AS (SELECT skey, rank, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target,
        (source_size + {BLOCK} - 1) // {BLOCK} AS n_blocks FROM v),
    n AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * n_blocks / source_size + 0.5), n_blocks * {repeat}) ELSE 0 END::BIGINT AS n_slots FROM t),
    h AS (SELECT *, greatest((sum(n_slots) OVER ())::BIGINT // {SHARD} + 1, 1) AS shards FROM n),
    i AS (SELECT skey, rank, shards, unnest(range(n_slots)) AS slot FROM h),
    f AS (SELECT skey, {draw('slot', '31', f'(rank * 64 + {seed} * 4099)')} % shards AS shard, count(*) AS n FROM i GROUP BY ALL),
    g AS (SELECT skey, shard, n, (sum(n) OVER (PARTITION BY skey ORDER BY shard ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM f),
    j AS (SELECT g.skey, rank, n_blocks, shard, start + unnest(range(g.n)) AS slot FROM g JOIN n USING (skey)),
    k AS (SELECT *, rank * 64 + slot // n_blocks + {seed} * 4099 AS key FROM j),
    b AS (SELECT skey, shard, list_reduce(list_concat([slot % n_blocks], range(1, {ROUNDS + 1})), lambda x, r: {swap}) AS block FROM k),
    m AS (SELECT skey, block, count(*) AS times, list(DISTINCT shard) AS inside FROM b GROUP BY skey, block),
    e AS (SELECT nth, skey, spot, size, unnest(range(spot // {BLOCK}, (spot + size - 1) // {BLOCK} + 1)) AS block FROM p WHERE size > 0),
    q AS (SELECT nth, sum((least(spot + size, (block + 1) * {BLOCK}) - greatest(spot, block * {BLOCK})) * times)::BIGINT AS taken,
        len(list_distinct(flatten(list(inside))))::BIGINT AS shards FROM e JOIN m USING (skey, block) GROUP BY nth)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(shards, 0) AS shards
    FROM p JOIN t USING (skey) LEFT JOIN q USING (nth)"""
