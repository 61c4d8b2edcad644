"""Measures of retrieval and grounding, as aggregations over ranked rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.durable import durable

#: Ranges of values that a group is counted by at once.
RANGES = 1024
#: Grades from here on count as relevant (fixed value).
RELEVANT = 2


def ranking_measures(ranking: DataFrame, grades: DataFrame, cutoffs: list[int], item: str = "item") -> DataFrame:
    """(query_id, k, precision, recall, dcg, idcg, ndcg) at each cutoff. ``ranking`` has query_id, item and
    rank, ``grades`` query_id, item and grade.

    Precision divides by what was returned, up to k, and is 0 where nothing was; recall is null without relevant
    items, nDCG where the ideal is zero. Queries are those of ``grades``.
    """
    judged = ranking.join(grades, ["query_id", item], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    return graded_measures(judged, grades.groupBy("query_id", "grade").agg(F.count("*").alias("items")), cutoffs)


def graded_measures(judged: DataFrame, supply: DataFrame, cutoffs: list[int]) -> DataFrame:
    """The same from the grades of what was returned (query_id, rank, grade) and the number of ``items`` of each query
    and grade (query_id, grade, items): the ideal ranking is known from these numbers, without its items."""
    ks = F.explode(F.array(*map(F.lit, cutoffs))).alias("k")
    gain = F.pow(F.lit(2.0), "grade") - 1
    got = judged.select("*", ks).where("rank <= k").groupBy("query_id", "k").agg(F.count("*").alias("returned"), F.sum((F.col("grade") >= RELEVANT).cast("int")).alias("hits"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    discounts = [0.0]
    for rank in range(1, max(cutoffs) + 1):
        discounts.append(discounts[-1] + 1 / math.log2(rank + 1))
    upto = lambda rank: F.get(F.array(*map(F.lit, discounts)), F.least(rank, F.col("k")).cast("int"))
    place = supply.withColumn("end", F.sum("items").over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).select("*", ks)
    best = place.groupBy("query_id", "k").agg(
        F.sum(F.when(F.col("grade") >= RELEVANT, F.col("items")).otherwise(0)).alias("relevant"), F.sum(gain * (upto(F.col("end")) - upto(F.col("end") - F.col("items")))).alias("idcg"),
    )
    both = best.join(got, ["query_id", "k"], "left").fillna(0, ["returned", "hits", "dcg"])
    return both.select(
        "query_id", "k", F.coalesce(F.try_divide("hits", "returned"), F.lit(0.0)).alias("precision"), F.try_divide("hits", "relevant").alias("recall"),
        F.col("dcg").cast("double").alias("dcg"), "idcg", F.try_divide("dcg", "idcg").alias("ndcg"),
    )


def evidence_coverage(required: DataFrame, supported: DataFrame) -> DataFrame:
    """(request_id, coverage): the share of distinct required elements that are supported."""
    both = required.select("request_id", "element").distinct().join(supported.select("request_id", "element", F.lit(True).alias("s")).distinct(), ["request_id", "element"], "left")
    return both.groupBy("request_id").agg(F.avg(F.coalesce(F.col("s"), F.lit(False)).cast("int")).alias("coverage"))


def citation_measures(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run_id, links, resolvable, correct): shares of links whose fragment is there, and of those that also
    support their claim with authority. ``links`` has run_id, chunk_id, supports and authoritative."""
    known = chunks.select("chunk_id", F.lit(True).alias("_known"))
    out = links.join(known, "chunk_id", "left").withColumn("_r", F.col("_known").isNotNull())
    return out.groupBy("run_id").agg(F.count("*").alias("links"), F.avg(F.col("_r").cast("int")).alias("resolvable"), F.avg((F.col("_r") & F.col("supports") & F.col("authoritative")).cast("int")).alias("correct"))


def claim_measures(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, claims, coverage, mandatory_coverage, unsupported_rate). Mandatory claims need primary evidence; shares
    of nothing are null. ``claims``: run_id, claim_id, mandatory, verdict; ``evidence``: claim_id, knowledge_base_role."""
    held = evidence.groupBy("claim_id").agg(F.bool_or(F.col("knowledge_base_role") == "primary").alias("primary"))
    out = claims.join(held, "claim_id", "left").withColumn("enough", F.when(F.col("mandatory"), F.coalesce("primary", F.lit(False))).otherwise(F.col("primary").isNotNull()))
    count = lambda c: F.sum(c.cast("int"))
    return out.groupBy("run_id").agg(
        F.count("*").alias("claims"), F.try_divide(count(F.col("enough")), F.count("*")).alias("coverage"),
        F.try_divide(count(F.col("enough") & F.col("mandatory")), count(F.col("mandatory"))).alias("mandatory_coverage"),
        F.try_divide(count(F.col("verdict") == "unsupported"), F.count("*")).alias("unsupported_rate"),
    )


def confusion(pairs: DataFrame, truth: str, found: str) -> DataFrame:
    """(truth, found, n): how often each class was taken for each."""
    return pairs.groupBy(F.col(truth).cast("string").alias("truth"), F.col(found).cast("string").alias("found")).agg(F.count("*").alias("n"))


def class_measures(pairs: DataFrame, truth: str, found: str) -> DataFrame:
    """(class, support, precision, recall, f1), and a row 'macro' with the mean F1. One aggregation of the confusion
    counts; each class's sums are taken from those few rows."""
    side = lambda name: F.struct(F.col(name).alias("class"), F.lit(name).alias("side"))
    ends = confusion(pairs, truth, found).select(F.explode(F.array(side("truth"), side("found"))).alias("e"), (F.col("truth") == F.col("found")).alias("hit"), "n").select("e.*", "hit", "n")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    per = ends.groupBy("class").agg(of(F.col("side") == "truth").alias("support"), of(F.col("side") == "found").alias("found"), of((F.col("side") == "truth") & F.col("hit")).alias("hits"))
    each = per.select("class", "support", F.coalesce(F.try_divide("hits", "found"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)).alias("recall"), (2.0 * F.col("hits") / (F.col("support") + F.col("found"))).alias("f1"))
    macro = each.agg(F.lit("macro").alias("class"), F.sum("support").alias("support"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return each.unionByName(macro)


def nearest_rank(values: Column, share: float) -> Column:
    """The element of the sorted values at ``share`` of the way, rounded half to even; an aggregate for groups whose
    values fit a row."""
    held = F.sort_array(F.collect_list(values))
    return F.when(F.size(held) > 0, F.get(held, F.bround(F.lit(share) * (F.size(held) - 1), 0).cast("int")))


def values_at(rows: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The key and, for each of ``ranks`` - a function of the number of values of a group - the value that stands at that rank (from
    0) among the sorted values of the group.

    No group is brought together: its values are counted by ``RANGES`` ranges of equal width, the range that holds the rank is
    counted by finer ranges, and so on until it holds a single value. Each time one row for each key, rank and range
    is shuffled, and the ranges of a key and rank are all that a window orders. Nulls and NaN are left out.
    """
    v = F.col(value).cast("double")
    held = rows.where(v.isNotNull() & ~F.isnan(v)).select(F.col(key).alias("key"), v.alias("v"))
    whole = held.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    goals = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("at")) for name, rank in ranks.items()))).alias("g")
    open_ = durable(whole.select("key", "low", "high", goals).select("key", "g.name", "g.at", "low", "high"))
    done = None
    while True:
        found = open_.where("low = high")
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        inside = held.join(open_, "key").where("v BETWEEN low AND high")
        share = F.nanvl((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.5))  # NaN: between infinite ends
        which = F.when(F.col("v") == F.col("high"), RANGES - 1).otherwise(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int"))
        counted = inside.groupBy("key", "name", "at", which.alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        run = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "name").orderBy("range")))
        open_ = durable(run.where("upto - n <= at AND at < upto").select("key", "name", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), "low", "high"))
    kind = rows.schema[value].dataType
    return done.groupBy(F.col("key").alias(key)).agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).cast(kind).alias(name) for name in ranks))


def nearest_rank_by(rows: DataFrame, key: str, value: str, share: float, name: str = "value") -> DataFrame:
    """``nearest_rank`` for groups of any size."""
    return values_at(rows, key, value, {name: lambda n: F.bround(F.lit(share) * (n - 1), 0)})


def median_by(rows: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """The median of groups of any size: the mean of the two values in the middle."""
    middle = values_at(rows, key, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)})
    return middle.select(key, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def bootstrap_interval(scores: DataFrame, rounds: int = 200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(mean, low, high): a bootstrap over requests, all rows of a request staying together. ``scores`` has request_id
    and value. A request is drawn in a round as often as a hash of both says: Poisson(1), by its first eight terms."""
    per = scores.groupBy("request_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.pmod(F.xxhash64("request_id", "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, limit, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        limit += term
        weight = weight + (u >= limit).cast("int")
        term /= k
    means = drawn.withColumn("w", weight).groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    low = (1 - level) / 2
    whole = per.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    return whole.join(F.broadcast(means.agg(F.percentile("m", low).alias("low"), F.percentile("m", 1 - low).alias("high"))))


def select_architecture(runs: DataFrame, gates: Column) -> DataFrame:
    """The first of the runs that pass the gates: by grounding, then correctness, then alignment, then least cost."""
    return runs.where(gates).orderBy(F.desc("grounding"), F.desc("correctness"), F.desc("alignment"), "cost", "architecture").limit(1)


def as_metric_rows(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric: the keys, metric_name, metric_value."""
    return wide.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric_name", "metric_value")


def trace_summary(documents: DataFrame) -> DataFrame:
    """One row: counts, fragments, and times of uploads and processing (zeros left out). Times stay where they are: their
    median and high ranks are found by ``values_at``. ``trace_failures`` lists the failed files."""
    done = F.col("status") == "succeeded"
    busy = F.when(done & (F.col("processing_s") != 0), F.col("processing_s"))
    rows = documents.select(F.lit(0).alias("all"), done.alias("done"), "chunk_count", F.col("upload_ms").cast("double").alias("upload_ms"), busy.cast("double").alias("busy"))
    counts = rows.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(F.col("done").cast("int")), F.lit(0)).alias("indexed"), F.coalesce(F.sum((~F.col("done")).cast("int")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("done"), F.col("chunk_count"))), F.lit(0)).alias("chunks"), F.round(F.coalesce(F.sum("busy"), F.lit(0.0)), 3).alias("processing_s_total"), F.lit(0).alias("all"),
    )
    middle = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)}
    upload = values_at(rows, "all", "upload_ms", middle | {"p95": lambda n: F.bround(F.lit(0.95) * (n - 1), 0)})
    upload = upload.select("all", F.round((F.col("low") + F.col("high")) / 2, 2).alias("upload_ms_median"), F.round("p95", 2).alias("upload_ms_p95"))
    process = values_at(rows, "all", "busy", middle).select("all", F.round((F.col("low") + F.col("high")) / 2, 3).alias("processing_s_median"))
    # one row each
    return counts.join(F.broadcast(upload), "all", "left").join(F.broadcast(process), "all", "left").drop("all")


def trace_failures(documents: DataFrame) -> DataFrame:
    """(file): the files that failed, any number of them."""
    return documents.where("status <> 'succeeded'").select("file")
