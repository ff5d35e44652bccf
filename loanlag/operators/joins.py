"""Join helpers for keys that are null on most rows.

Hash partitioning sends every null key to the same shuffle partition.  When a
column is mostly null (a listing's parent, say) a plain anti or left join puts
most of a table into one task, although a null key can never match.  These
helpers add a second join key that is 0 for non-null keys and a deterministic
spread value for null keys, so the null rows scatter over the partitions while
the match result stays the same.  The spread is a hash of the row's own
columns (or of a unique column the caller names): a retried task recomputes
exactly the same partitioning.

The right side's spread key must stay a real join key.  A literal 0 would be
constant-folded by the optimizer into a post-join filter, leaving the null
rows hashed together again; ``key * 0`` is 0 for every key that can match
(and null otherwise), which no rule folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_null_spread"


def _salted(df: DataFrame, key: str, spread_on: list[str] | None) -> DataFrame:
    # The whole hash, not a bucket of it: nothing is replicated for the spread,
    # so null rows may reach every shuffle partition there is.
    spread = F.xxhash64(*(spread_on or df.columns))
    return df.withColumn(_SALT, F.when(F.col(key).isNull(), spread).otherwise(F.lit(0)).cast("long"))


def _constant(key: str):
    # 0 for every key that can match; a literal would be folded away.
    return (F.col(key) * 0).cast("long")


def _zero(key: str):
    return _constant(key).alias("_rs")


def anti_join_nullable(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       spread_on: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` whose ``left_key`` matches no ``right_key``.

    A null ``left_key`` never matches, so such rows are always kept.  Null
    rows are spread by a hash of ``spread_on`` (default: all columns; a
    unique column is enough and cheaper).
    """
    l = _salted(left, left_key, spread_on)
    r = right.select(F.col(right_key).alias("_rk"), _zero(right_key))
    cond = (l[left_key] == r["_rk"]) & (l[_SALT] == r["_rs"])
    return l.join(r, cond, "left_anti").drop(_SALT)


def left_join_nullable(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       spread_on: list[str] | None = None) -> DataFrame:
    """``left`` left-outer-joined to ``right`` on ``left_key == right_key``.

    The right key column is dropped from the output; ``spread_on`` as in
    ``anti_join_nullable``.
    """
    l = _salted(left, left_key, spread_on)
    r = right.withColumn("_rs", _zero(right_key))
    cond = (l[left_key] == r[right_key]) & (l[_SALT] == r["_rs"])
    return l.join(r, cond, "left").drop(_SALT, "_rs").drop(r[right_key])


# The list of hot keys is broadcast.  It has fewer keys than this, whatever the
# data: a key is on it only if it holds more than this share of the rows of all
# keys above ``target_rows``.
HOT_KEY_BOUND = 100_000


def hot_keys(df: DataFrame, key: str, target_rows: int, among: DataFrame | None = None) -> DataFrame:
    """Values of ``key`` holding more than ``target_rows`` rows of ``df``, with
    the number of ``_buckets`` to deal each into: about ``target_rows`` rows a
    bucket.

    ``among``: only keys of this table (column ``key``) count.  Fewer than
    ``HOT_KEY_BOUND`` keys are returned by arithmetic, without a sort or a
    limit: beyond that number of keys above ``target_rows``, the target rises
    to the ``HOT_KEY_BOUND``-th part of the rows they hold together, so a key
    left off the list is smaller than that part.  The count per key is a
    partial aggregate before its shuffle, so even a key with a third of all
    rows costs one row per map task.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > int(target_rows))
    if among is not None:
        counts = counts.join(among.select(key), key, "left_semi")
    # A plain aggregation: partial sums per task, one row in all, never a window
    # over every counted key.
    together = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_together")).scalar()
    target = F.greatest(F.lit(int(target_rows)), F.floor(together / HOT_KEY_BOUND))
    hot = counts.withColumn("_target", target).where(F.col("_rows") > F.col("_target"))
    return hot.select(key, F.ceil(F.col("_rows") / F.col("_target")).cast("int").alias("_buckets"))


def splittable_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner equi-join of ``big`` and ``small`` on ``key`` that AQE may split.

    AQE splits a skewed partition of a sort-merge join only where both sides
    are plain shuffles.  A side that is already partitioned by ``key`` (an
    aggregate or a join on it) gets no shuffle of its own and pins the whole
    partition to one task.  A second key that is 0 for every row makes both
    sides shuffle on (key, 0): the hot key's rows of ``big`` are then split
    along its map outputs and its rows of ``small`` read by each part.
    Nothing is counted beforehand and nothing replicated in the plan, so
    Spark's runtime bloom filter from ``small`` can still reach ``big``'s scan.
    """
    return (big.withColumn("_one", _constant(key)).join(small.withColumn("_one", _constant(key)), [key, "_one"])
            .drop("_one"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: list[str]) -> DataFrame:
    """Inner equi-join of ``big`` and ``small`` on ``key`` that splits hot keys.

    ``hot`` gives each hot key its ``_buckets`` (``hot_keys``).  Rows of
    ``big`` with a hot key are spread over that many salt values by a
    deterministic hash of ``spread`` columns; the matching ``small`` rows are
    replicated once per salt value.  Both sides are then shuffled on (key,
    salt), so a hot key lands in many tasks instead of one, and each big row
    still meets every small row of its key exactly once.
    """
    flag = F.broadcast(hot.select(key, "_buckets"))
    is_hot = F.col("_buckets").isNotNull()
    b = (big.join(flag, key, "left")
         .withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.col("_buckets")))
                     .otherwise(F.lit(0)).cast("int"))
         .drop("_buckets"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.col("_buckets") - 1)).otherwise(F.array(F.lit(0)))
    s = small.join(flag, key, "left").withColumn("_salt", F.explode(copies)).drop("_buckets")
    return b.join(s, [key, "_salt"]).drop("_salt")
