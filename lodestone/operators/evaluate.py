"""Retrieval quality: ranks of matches, recall, histograms, what re-ranking changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ((1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, 50))


def chunk_matches(section: Column, refs: Column, prefixes: Column, ids: Column, strict: bool = False) -> Column:
    """A chunk counts if its id starts with a prefix or is a wanted table, or if it names one. strict: the prefix's last
    number must end there, so 300.5 isn't in 300.50."""
    whole = lambda x: ~F.substr(section, F.length(x) + 1, F.lit(1)).rlike("[0-9]") if strict else F.lit(True)
    return F.exists(prefixes, lambda x: section.startswith(x) & whole(x)) | F.array_contains(ids, section) | F.arrays_overlap(refs, ids)


def first_ranks(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, match; match is null without ground truth) -> query_id, skipped, first_rank and all ranks."""
    ranks = F.array_sort(F.collect_list(F.when(F.col("match"), F.col("rank"))))
    return hits.groupBy("query_id").agg(F.every(F.col("match").isNull()).alias("skipped"), F.min(F.when(F.col("match"), F.col("rank"))).alias("first_rank"), F.array_join(ranks, ",").alias("ranks"))


def recall(ranks: DataFrame, sizes: tuple[int, ...] = (5, 10, 20, 30, 50)) -> DataFrame:
    """n, hits, misses and recall; queries without ground truth are left out."""
    rows = ranks.select("skipped", "first_rank", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    one = rows.groupBy(F.col("n").cast("bigint").alias("n")).agg(F.count_if(~F.col("skipped") & F.coalesce(F.col("first_rank") <= F.col("n"), F.lit(False))).alias("hits"), F.count_if(~F.col("skipped")).alias("asked"))
    return one.select("n", "hits", (F.col("asked") - F.col("hits")).alias("misses"), F.when(F.col("asked") > 0, F.round(F.col("hits") / F.col("asked"), 6)).alias("recall"))


def histogram(ranks: DataFrame, most: int = 50) -> DataFrame:
    """low, high and count of first ranks; ends before the first bucket that passes ``most``."""
    kept = [b for i, b in enumerate(BUCKETS) if all(x[1] <= most for x in BUCKETS[: i + 1])]
    inside = [F.count_if(F.col("first_rank").between(a, b)).alias(f"b{i}") for i, (a, b) in enumerate(kept)]
    one = ranks.agg(*inside)
    rows = F.array(*(F.struct(F.lit(a).cast("bigint").alias("low"), F.lit(b).cast("bigint").alias("high"), F.col(f"b{i}").alias("n")) for i, (a, b) in enumerate(kept)))
    return one.select(F.inline(rows))


def rank_change(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() & after.isNull(), "unchanged").when(before.isNull(), "new").when(after.isNull(), "lost")
        .when(after < before, "improved").when(after > before, "worsened").otherwise("unchanged")
    )


def change_summary(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, before, after) -> counts of changes, mean ranks where both exist, promotions to the top five."""
    c = rank_change(F.col("before"), F.col("after"))
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return pairs.agg(
        F.count_if(c.isin("improved", "new")).alias("improved"), F.count_if(c.isin("worsened", "lost")).alias("worsened"), F.count_if(c == "unchanged").alias("unchanged"),
        F.round(F.avg(F.when(both, F.col("before"))), 6).alias("mean_before"), F.round(F.avg(F.when(both, F.col("after"))), 6).alias("mean_after"),
        F.count_if((F.col("after") <= 5) & F.coalesce(F.col("before") > 5, F.lit(True))).alias("promoted"),
    )


def miss_details(judged: DataFrame, n: int, most: int = 10) -> DataFrame:
    """The first ``most`` of judged (query_id, rank, match, ...) of queries with ground truth but no match up to n."""
    r = first_ranks(judged)
    missed = r.where(~F.col("skipped") & (F.col("first_rank").isNull() | (F.col("first_rank") > n))).select("query_id")
    return judged.join(missed, "query_id", "left_semi").where(F.col("rank") <= most)


def pass_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))


def same_answer(a: Column, b: Column) -> Column:
    """A judge that needs no model: equal letters and digits, whatever the case and what stands between."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return plain(a) == plain(b)


def shown_rank(rank: Column) -> Column:
    return F.when(rank.isNull(), "MISS").otherwise(F.concat(F.lit("#"), rank.cast("string")))


def comparison(pairs: DataFrame) -> DataFrame:
    """query_id, embedding, reranked and change as they are shown, of pairs (query_id, skipped, before, after)."""
    b, a = F.col("before"), F.col("after")
    step = F.when(b > a, F.concat(F.lit("+"), (b - a).cast("string"))).when(b < a, (b - a).cast("string")).when(b == a, "=")
    change = F.coalesce(step, F.when(a.isNotNull(), "NEW").when(b.isNotNull(), "LOST").otherwise("-"))
    na = lambda x: F.when(F.col("skipped"), "n/a").otherwise(x)
    return pairs.select("query_id", na(shown_rank(b)).alias("embedding"), na(shown_rank(a)).alias("reranked"), na(change).alias("change"))


def comparison_detail(judged: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """query_id, ordering, place, vec_id and hit: the first places of either order, of the queries whose first match moved
    or stands behind the fifth place."""
    same = F.col("before").eqNullSafe(F.col("after")) & F.coalesce(F.col("before") <= 5, F.lit(False))
    rows = judged.join(pairs.where(~F.col("skipped") & ~same).select("query_id"), "query_id", "left_semi")
    both = F.array(F.struct(F.lit("embedding").alias("ordering"), F.col("rank").alias("place")), F.struct(F.lit("reranked").alias("ordering"), F.col("rerank").alias("place")))
    return rows.select("query_id", "vec_id", F.col("match").alias("hit"), F.inline(both)).where(F.col("place") <= most)
