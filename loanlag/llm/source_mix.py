"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled and cut into blocks of equally many words.
The schedule's slots are golden-ratio points: the n-th point, mapped through
the sources' cumulative shares, names the source of slot n, so every stretch
of the schedule has the shares as nearly as can be.  A slot's rank among its
source's slots names the block it takes; past the last block the source
begins anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_all_columns, id_key, materialize, text_hash, total_before

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block.
BLOCK_WORDS = 1024
#: No source gives more than so many times its words.
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Points are multiples of 2^32 / golden ratio, modulo 2^32.
POINTS, STEP = 2**32, 2654435769


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, source, size, shuffle): words of each row and its place in its source's shuffled order, from id and text: rows of one id, null ids too, are spread."""
    of_text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), of_text)).alias("shuffle"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: src, source, source_size, target, take, epochs, rest, blocks, slots.

    The targets share the sum of all sizes by weight; a source's target stops
    at ``repeats`` times its size and the others share the rest by weight.
    Sources in ascending order of that limit per weight: while a source's
    limit is below its part of what is left, it is filled; from the first
    one that is not, all get their parts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("src", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, F.col("src") % len(weights) + 1))
    limit = F.col("source_size").cast("double") * repeats
    order = Window.orderBy(limit / F.col("weight"), "src")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left).withColumn("full", limit <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct((limit / F.col("weight")).alias("at"), "src", "level"))).over(everything)
    per = per.withColumn("target", F.when(F.col("full"), limit).otherwise(first["level"] * F.col("weight")))
    take = F.least(F.floor("target").cast("long"), F.col("source_size") * repeats)
    per = per.withColumn("take", take).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    per = per.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.col("take") - F.col("epochs") * F.col("source_size"))
    slots = F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_WORDS)
    return per.select("src", "source", "source_size", "target", "take", "epochs", "rest", "blocks", slots.cast("long").alias("slots"))


def schedule(per_source: DataFrame) -> DataFrame:
    """(slot, src, rank, block, words): which block each slot takes, and how many of its words.

    A source has exactly the slots that its target needs: what the points
    give beyond them is dropped, what they lack stands at the end.
    """
    spark = per_source.sparkSession
    n = per_source.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    ahead = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    bounds = per_source.where(F.col("slots") > 0).select(
        "src", F.ceil(F.coalesce(F.sum("slots").over(ahead), F.lit(0)) / F.lit(max(n, 1)) * POINTS).cast("long").alias("u"))
    # Both halves of the number by themselves: no product leaves a long.
    low, high = F.col("id") % 2**16, F.shiftright(F.col("id") % POINTS, 16)
    points = spark.range(n).select(F.col("id").alias("slot"), ((high * STEP % POINTS * 2**16 + low * STEP) % POINTS).alias("u"))
    # The source of a point is the last one whose part begins at or before it.
    nth = bounds.select((F.row_number().over(Window.orderBy("src")) - 1).cast("long").alias("nth"), "src")
    marks = bounds.select(F.lit(None).cast("long").alias("slot"), "u", F.lit(1).cast("long").alias("one")).unionByName(
        points.withColumn("one", F.lit(0).cast("long"))).withColumn("bucket", F.shiftright("u", 20))
    placed = total_before(marks, [], "bucket", ["u", F.desc("one")], "one", "n_begun").where(F.col("slot").isNotNull())
    placed = placed.select("slot", (F.col("n_begun") - 1).alias("nth")).join(nth, "nth").select("slot", "src")
    placed = materialize(placed.withColumn("bucket", F.shiftright("slot", 16)).withColumn("one", F.lit(1).cast("long")))
    ranked = total_before(placed, ["src"], "bucket", ["slot"], "one", "rank").select("slot", "src", "rank")
    counts = placed.groupBy("src").agg(F.count("*").alias("given"))
    missing = per_source.join(counts, "src", "left").select("src", "slots", F.coalesce("given", F.lit(0)).alias("given"))
    missing = missing.where(F.col("given") < F.col("slots")).select(
        F.lit(n).cast("long").alias("slot"), "src", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
    facts = per_source.select("src", "source_size", "take", "blocks", "slots")
    all_slots = ranked.unionByName(missing).join(facts, "src").where(F.col("rank") < F.col("slots"))
    block = F.col("rank") % F.col("blocks")
    start = F.floor(F.col("rank") / F.col("blocks")).cast("long") * F.col("source_size") + block * BLOCK_WORDS
    words = F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("source_size") - block * BLOCK_WORDS, F.col("take") - start)
    return all_slots.select("slot", "src", "rank", block.alias("block"), words.alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) of every row.

    ``taken``: the words that the schedule's slots take of the row, repeats
    counted: its source's blocks hold the shuffled rows one after another.
    A source's rows give ``floor(target)`` words together.  A null text has
    no words; null sources are one source, the last; rows of a null id are
    shuffled like others; repeated rows each have a place.  A row without
    words gives none; an empty table gives no rows.  Other columns are not
    read.
    """
    sizes = materialize(sized(docs, id_col, text_col, source_col))
    per_source = materialize(targets(sizes))
    rows = sizes.join(per_source.select("src", F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.drop("of").withColumn("bucket", F.substring("shuffle", 1, 3))
    placed = total_before(rows, ["src"], "bucket", ["shuffle", "size", "text_hash"], "size", "before")
    used = schedule(per_source)
    whole = F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("source_size") - F.col("block") * BLOCK_WORDS)
    used = used.join(per_source.select("src", "source_size"), "src").groupBy("src", "block").agg(
        F.sum((F.col("words") == whole).cast("long")).alias("times"),
        F.coalesce(F.max(F.when(F.col("words") < whole, F.col("words"))), F.lit(0).cast("long")).alias("part"))
    first, last = F.floor(F.col("before") / BLOCK_WORDS), F.floor((F.col("before") + F.col("size") - 1) / BLOCK_WORDS)
    pieces = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("before") - F.col("block") * BLOCK_WORDS, F.lit(0).cast("long"))
    end = F.least(F.col("before") + F.col("size") - F.col("block") * BLOCK_WORDS, F.lit(BLOCK_WORDS).cast("long"))
    pieces = pieces.withColumn("begin", begin).withColumn("end", end).join(used, ["src", "block"], "left")
    got = F.col("times") * (F.col("end") - F.col("begin")) + F.least(F.greatest(F.col("part") - F.col("begin"), F.lit(0).cast("long")), F.col("end") - F.col("begin"))
    keys = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    taken = pieces.groupBy(*keys, "before").agg(F.coalesce(F.sum(got), F.lit(0).cast("long")).alias("taken")).drop("before")
    return taken.unionByName(placed.where(F.col("size") == 0).select(*keys, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, with all their columns: a row stands as often as it is taken whole, and once more, cut, for the rest.

    What is taken of rows of equal id, text and source is added up and goes
    to one of them, the first by all their columns.
    """
    taken = mix(docs, id_col, text_col, source_col).groupBy(
        id_key(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash"), F.xxhash64("source").alias("__source"), "size").agg(F.sum("taken").alias("__taken"))
    keys = ["__id", "__hash", "__source"]
    rows = docs.withColumns({"__id": id_key(F.col(id_col).cast("long")), "__hash": text_hash(F.col(text_col)), "__source": F.xxhash64(F.col(source_col).cast("string"))})
    same = Window.partitionBy(*keys).orderBy(*by_all_columns(docs))
    rows = rows.join(taken.where("__taken > 0").withColumnRenamed("size", "__size"), keys).withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1)
    whole, rest = F.floor(F.col("__taken") / F.col("__size")).cast("int"), F.col("__taken") % F.col("__size")
    copies = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), rest.cast("int")), "")
    cut = F.when(F.col("__copy") <= whole, F.col(text_col)).otherwise(first_words)
    return copies.withColumn(text_col, cut).select(*docs.columns)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``mix``: the words of a source's first ``take`` in endless repetition."""
    weights = f"[{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}]"
    return f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS shuffle FROM {table}),
named AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sizes GROUP BY source),
weighed AS (SELECT *, {weights}[src % {len(WEIGHTS)} + 1] AS weight, source_size::DOUBLE * {MAX_REPEATS} AS lim FROM named),
level AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY lim / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT *, CASE WHEN lim <= level * weight THEN lim ELSE
  weight * (SELECT arg_min(level, (lim / weight, src)) FROM level WHERE NOT lim <= level * weight) END AS target FROM level),
takes AS (SELECT source, source_size, target, least(floor(target)::BIGINT, source_size * {MAX_REPEATS}) AS take FROM aimed),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE take // source_size * size
    + greatest(least(take % source_size - before, size), 0) END)::BIGINT AS taken
FROM placed p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source"""
