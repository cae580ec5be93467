"""Which messages are handled at all: repeats within a time-to-live, quotas, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import stripped_length_below, text_or_empty
from ..session import cut_lineage, written

# A key with more distinct times than this is not folded in one task but resolved by
# pointer doubling.
FOLD_LIMIT = 10_000
_SLICES = 4096


def _micros(ts: str) -> Column:
    """Microseconds since the epoch; zone-free timestamps count as UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.col(ts).cast("timestamp_ntz") - start
    return (F.extract(F.lit("DAY"), since).cast("long") * 86_400_000_000
            + F.extract(F.lit("HOUR"), since).cast("long") * 3_600_000_000
            + F.extract(F.lit("MINUTE"), since).cast("long") * 60_000_000
            + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long"))


# --- time-to-live dedupe -------------------------------------------------------------------
def _fold_anchors(ttl: int) -> Column:
    """Anchors of ascending (t, id): the first, then each first one past the TTL."""
    return F.aggregate(
        F.col("times"),
        F.array().cast("array<struct<t:bigint,id:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x["t"] > F.element_at(acc, -1)["t"] + ttl),
            F.concat(acc, F.array(x))).otherwise(acc))


def _runs(times: DataFrame, ttl: int) -> DataFrame:
    """Buckets of a key with their first time, whether a run (no gap above the TTL) starts
    in them, and the first time after the next bucket of the same run."""
    by_key = Window.partitionBy("k").orderBy("b")
    buckets = times.groupBy("k", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    gap = F.col("lo") - F.lag("hi").over(by_key) > ttl
    buckets = buckets.withColumn("starts_run", F.coalesce(gap, F.lit(True)))
    buckets = buckets.withColumn("run", F.sum(F.col("starts_run").cast("int")).over(by_key))
    follows = Window.partitionBy("k", "run").orderBy("b")
    next_b, next_lo = F.lead("b").over(follows), F.lead("lo").over(follows)
    return buckets.withColumn(
        "past_next", F.when(next_b == F.col("b") + 1, F.lead("lo", 2).over(follows))
        .otherwise(next_lo))


def _chain_anchors(times: DataFrame, ttl: int) -> DataFrame:
    """Anchors (k, t, id) of keys with too many times for one task.

    Every time points to the first later one past its TTL; the anchors are the times
    reached from the first one of a run. Pointers double each round, so a chain of n
    anchors takes log2(n) rounds. The pointer of a time in bucket b leads into bucket
    b + 1, or to the start of the next bucket after it; inside a bucket it is found slice
    by slice (a slice holds at most ttl / 4096 microsecond ticks), never over a whole key.
    """
    times = cut_lineage(times)
    buckets = cut_lineage(_runs(times, ttl))
    slice_of = F.floor((F.col("x") - F.col("b") * ttl) * _SLICES / ttl).cast("int")
    own = times.select("k", "b", F.col("t").alias("x"), F.col("t").alias("cand"),
                       F.lit(None).cast("long").alias("src"))
    probe = times.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + ttl).alias("x"),
                         F.lit(None).cast("long").alias("cand"), F.col("t").alias("src"))
    line = own.unionByName(probe).withColumn("s", slice_of)
    later = Window.partitionBy("k", "b").orderBy(F.desc("s")).rowsBetween(
        Window.unboundedPreceding, -1)
    slices = (
        line.groupBy("k", "b", "s").agg(F.min("cand").alias("first"))
        .withColumn("later_slice", F.min("first").over(later)).select(
            "k", "b", "s", "later_slice"))
    # Descending by time, a probe before a candidate at the same time: strictly later only.
    inside = Window.partitionBy("k", "b", "s").orderBy(
        F.desc("x"), F.asc_nulls_first("cand")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (
        line.withColumn("in_slice", F.min("cand").over(inside))
        .where(F.col("src").isNotNull())
        .join(slices, ["k", "b", "s"])
        .withColumn("b", F.col("b") - 1)
        .join(buckets.select("k", "b", "past_next"), ["k", "b"])
        .select("k", F.col("src").alias("t"),
                F.coalesce("in_slice", "later_slice", "past_next").alias("nxt")))
    jump = cut_lineage(found)
    reached = cut_lineage(
        buckets.where("starts_run").select("k", F.col("lo").alias("t")))
    while not jump.isEmpty():
        step = reached.join(jump, ["k", "t"]).select("k", F.col("nxt").alias("t"))
        reached = cut_lineage(
            reached.unionByName(step.where(F.col("t").isNotNull())).distinct())
        ahead = jump.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("nxt2"))
        jump = cut_lineage(
            jump.where(F.col("nxt").isNotNull()).join(ahead, ["k", "nxt"])
            .select("k", "t", F.col("nxt2").alias("nxt")).where(F.col("nxt").isNotNull()))
    return reached.join(times, ["k", "t"]).select("k", "t", "id")


def dedupe_ttl(df: DataFrame, key: str = "request_key", ts: str = "ts", order: str = "event_id",
               ttl_s: int = V.DEDUPE_TTL_S, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Mark repeats: a key seen again within the TTL of its anchor is a duplicate.

    The anchor is the first request that is no duplicate; repeats do not extend its life,
    and a repeat exactly at the end of the TTL still counts. Adds ``anchor_id`` (the order
    value of the request whose answer applies) and ``duplicate``; a request without a key
    or without a time is never a duplicate, nor an anchor.

    Times are first reduced to the distinct ones per key; a key is folded in one task, or
    resolved by ``_chain_anchors`` when it has very many. Anchors lie more than a TTL
    apart, so a TTL-wide bucket holds at most one, and the anchor of a request lies in its
    own bucket or the one before: requests find it by an equality join on the bucket.
    """
    ttl = ttl_s * 1_000_000
    keyed = F.nullif(F.col(key).cast("string"), F.lit("")).isNotNull() & F.col(ts).isNotNull()
    work = df.where(keyed).withColumns({"__t": _micros(ts)}).withColumn(
        "__b", F.floor(F.col("__t") / ttl).cast("long"))
    times = work.groupBy(F.col(key).cast("string").alias("k"), F.col("__b").alias("b"),
                         F.col("__t").alias("t")).agg(F.min(order).cast("long").alias("id"))
    times = written(times, "times")    # read for the hot keys, the folds and the chains
    hot = times.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > fold_limit).select("k")
    has_hot = not hot.isEmpty()
    foldable = times.join(hot, "k", "left_anti") if has_hot else times
    # No anchor reaches over a gap longer than the TTL, so runs between such gaps are folded
    # one by one; the lists stay short, and the key's partition serves both steps.
    by_key = Window.partitionBy("k").orderBy("t")
    starts = F.coalesce(F.col("t") - F.lag("t").over(by_key) > ttl, F.lit(True)).cast("int")
    foldable = foldable.withColumn("starts", starts).withColumn(
        "run", F.sum("starts").over(by_key))
    anchors = (
        foldable.groupBy("k", "run").agg(F.sort_array(F.collect_list(F.struct("t", "id")))
                                         .alias("times"))
        .select("k", F.inline(_fold_anchors(ttl))))
    if has_hot:
        anchors = anchors.unionByName(
            _chain_anchors(times.join(hot, "k", "left_semi"), ttl))
    # One row per bucket a request may fall into: its own anchor and the one before.
    mark, home = F.struct("t", "id"), F.floor(F.col("t") / ttl).cast("long")
    reach = anchors.select("k", mark.alias("a"), home.alias("home"),
                           F.explode(F.array(home, home + 1)).alias("b"))
    lookup = reach.groupBy("k", "b").agg(
        F.max(F.when(F.col("b") == F.col("home"), F.col("a"))).alias("own"),
        F.max(F.when(F.col("b") != F.col("home"), F.col("a"))).alias("earlier")).select(
        F.col("k").alias("__k"), F.col("b").alias("__bucket"), "own", "earlier")
    own_applies = F.col("own").isNotNull() & (F.col("own")["t"] <= F.col("__t"))
    answered = work.join(
        lookup, (F.col(key).cast("string") == F.col("__k")) & (F.col("__b") == F.col("__bucket"))
    ).withColumn("anchor_id", F.when(own_applies, F.col("own")["id"]).otherwise(
        F.col("earlier")["id"]))
    marked = answered.select(
        *df.columns, "anchor_id", (F.col("anchor_id") != F.col(order)).alias("duplicate"))
    free = df.where(~keyed).select(
        *df.columns, F.col(order).alias("anchor_id"), F.lit(False).alias("duplicate"))
    return marked.unionByName(free)


# --- quotas --------------------------------------------------------------------------------
def _nth(rows: DataFrame, group: list[str], order: list[str], n: int, out: str) -> DataFrame:
    """Order value of the n-th row of each group that has one.

    The rank filter lets every task keep n rows per group before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        rows.select(*group, *order).withColumn("__n", F.row_number().over(w))
        .where(F.col("__n") <= n).where(F.col("__n") == n)
        .select(*group, F.struct(*order).alias(out)))


def admit(requests: DataFrame, session: str = "session_id", ts: str = "ts",
          order: str = "event_id", body: str = "body", succeeded: str = "succeeded",
          enabled: bool = True, min_chars: int = V.ADMIT_MIN_CHARS,
          max_chars: int = V.ADMIT_MAX_CHARS, per_session: int = V.ADMIT_PER_SESSION,
          per_day: int = V.ADMIT_PER_DAY) -> DataFrame:
    """Add ``refusal`` to requests for a full analysis (null = admitted).

    Reasons in order: disabled, too_short, too_long, session, day. A failed run uses the
    quota of the day but not that of the session; session quotas count within a day.

    No group is ranked as a whole. A session is closed after its n-th success and a day
    after its m-th admitted request; these two cut-offs are the only things looked up.
    """
    day = F.col(ts).cast("date")
    body_text = text_or_empty(body)
    work = requests.withColumns({
        "__day": day,
        "__unfit": F.when(~F.lit(enabled), "disabled")
        .when(stripped_length_below(body, min_chars), "too_short")
        .when(F.length(body_text) > max_chars, "too_long")})
    at = F.struct(ts, order)
    fit = work.where(F.col("__unfit").isNull())
    closed = _nth(fit.where(F.col(succeeded)), [session, "__day"], [ts, order], per_session,
                  "__session_end")
    within = fit.join(closed, [session, "__day"], "left").where(
        F.col("__session_end").isNull() | (at <= F.col("__session_end")))
    full = _nth(within, ["__day"], [ts, order], per_day, "__day_end")
    # Days are few: one cut-off each. Sessions are not, so that join is left to Spark.
    joined = work.join(closed, [session, "__day"], "left").join(
        F.broadcast(full), "__day", "left")
    past_session = F.col("__session_end").isNotNull() & (at > F.col("__session_end"))
    past_day = F.col("__day_end").isNotNull() & (at > F.col("__day_end"))
    session_first = F.col("__day_end").isNull() | (
        F.col("__session_end") <= F.col("__day_end"))
    refusal = (
        F.when(F.col("__unfit").isNotNull(), F.col("__unfit"))
        .when(past_session & session_first, "session")
        .when(past_day, "day"))
    return joined.withColumn("refusal", refusal).select(*requests.columns, "refusal")


def expire(df: DataFrame, now: Column, hours: float = V.RETENTION_HOURS,
           ts: str = "ts") -> DataFrame:
    """Rows younger than the retention time."""
    zero = F.lit(0)
    limit = now - F.make_dt_interval(
        zero, zero, zero, F.lit(int(hours * 3600)).cast("decimal(18,6)"))
    return df.where(F.col(ts) >= limit)
