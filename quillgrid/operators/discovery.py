"""Repository discovery: filters, scores, quotas and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.ranges import numbered

# Licences and languages that are taken.
LICENSES = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "mpl-2.0", "unlicense", "0bsd"]
LANGUAGES = ["typescript", "python", "javascript", "go", "rust", "java"]


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two times, not calendar days."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400)


def skip_reason(stars: str = "stars", size: str = "size_kb") -> Column:
    """The first rule that a repository breaks, or null."""
    license_ = F.lower(F.coalesce("license", F.lit("")))
    bad = (license_ != "") & (license_ != "noassertion") & ~license_.isin(LICENSES)
    return (
        F.when(F.coalesce("archived", F.lit(False)), F.lit("archived"))
        .when(F.coalesce("fork", F.lit(False)), F.lit("fork"))
        .when(F.col(stars) < 200, F.concat(F.lit("too_few_stars ("), F.col(stars).cast("string"), F.lit(")")))
        .when(bad, F.concat(F.lit("license ("), license_, F.lit(")")))
        .when(F.col(size) < 500, F.concat(F.lit("too_small ("), F.col(size).cast("string"), F.lit("KB)")))
    )


def signals(now: Column) -> list[tuple[Column, Column]]:
    """Points and evidence; a signal without points is null."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n, people, stars = F.size(F.coalesce("coauthor_signals", F.array())), F.col("contributors"), F.col("stars")
    time = lambda c: F.try_to_timestamp(F.col(c))
    age = whole_days(now, time("created_at"))
    comma = F.format_number(stars, 0)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    tools = F.size(F.array_distinct("coauthor_signals"))
    return [
        (F.when(n >= 5, 30).when(n >= 1, 15), F.when(n >= 5, say(n, " AI co-authored commits (", tools, " distinct tools)")).otherwise(say(n, " AI co-authored commits"))),
        (F.when(yes("has_cursorrules"), 5), F.lit("Has .cursorrules config")),
        (F.when(yes("has_topic_match"), 5), F.lit("AI-related topic tags")),
        (F.when(yes("has_ci"), 10), F.lit("Has CI/CD pipeline")),
        (F.when(yes("has_tests"), 10), F.lit("Has test suite")),
        (F.when(people >= 20, 10).when(people >= 10, 7).when(people >= 5, 4), F.when(people >= 20, say(people, "+ contributors (large team)")).otherwise(say(people, " contributors"))),
        (F.when(stars >= 5000, 10).when(stars >= 1000, 7).when(stars >= 500, 5).otherwise(2), F.when(stars >= 5000, say(comma, " stars (major project)")).otherwise(say(comma, " stars"))),
        (F.when(whole_days(now, time("pushed_at")) <= 30, 5), F.lit("Active in last 30 days")),
        (F.when(age > 365, 5), say("Mature (", F.floor(age / 365), "+ years old)")),
        (F.when(F.lower("language").isin(LANGUAGES), 5), say("Primary language: ", F.col("language"))),
        (F.when(~yes("is_enterprise") & (F.col("ai_commit_count") > 0), 5), say(F.col("ai_commit_count"), " commits with AI-related messages")),
    ]


def score(repos: DataFrame, now: Column) -> DataFrame:
    """Adds skip_reason, score, evidence and track. What a skipped repository has beside its first three signals doesn't count."""
    rules = signals(now)
    reason = skip_reason()
    points = sum((F.coalesce(p, F.lit(0)) for p, _ in rules[1:]), F.coalesce(rules[0][0], F.lit(0)))
    listed = lambda some: F.filter(F.array(*(F.when(p.isNotNull(), e) for p, e in some)), lambda x: x.isNotNull())
    return repos.select("*", reason.alias("skip_reason"), F.when(reason.isNotNull(), 0).otherwise(points).alias("score"), F.when(reason.isNotNull(), listed(rules[:3])).otherwise(listed(rules)).alias("evidence"), F.when(F.coalesce("is_enterprise", F.lit(False)), "enterprise").otherwise("ai-signal").alias("track"))


def outcomes(scored: DataFrame, least: int) -> DataFrame:
    return scored.withColumn("outcome", F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("score") >= least, "qualified").otherwise("below_threshold"))


def outcome_counts(scored: DataFrame, least: int) -> DataFrame:
    return outcomes(scored, least).groupBy("track").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("qualified", "skipped", "below_threshold")))


def since(now: Column, days: int = 90) -> Column:
    """The date so many days before, as search queries have it."""
    return F.date_format(F.date_sub(now.cast("date"), days), "yyyy-MM-dd")


def quota(rows: DataFrame, most: int, by: str = "track", points: str = "score", name: str = "repo", track: str = "both") -> DataFrame:
    """At most `most` rows: first the best max(2, 2 * most / 5) of each group, then the best of the rest; ordered by points. Of one track, or of four rows or fewer, the best by points alone."""
    each = max(2, 2 * most // 5)
    order = [F.desc(points), F.asc(name)]
    if track != "both" or len(rows.select(name).limit(5).collect()) < 5:
        return rows.orderBy(*order).limit(most)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("reserved", F.col("k") <= each)
    return first.orderBy(F.desc("reserved"), *order).limit(most).drop("k", "reserved").orderBy(*order)


def candidates(sources: list[DataFrame], block: list[DataFrame], key: str = "repo") -> DataFrame:
    """Distinct keys of any source less those of the block lists."""
    found = sources[0].select(key)
    for s in sources[1:]:
        found = found.union(s.select(key))
    found = found.distinct()
    for b in block:
        found = found.join(b.select(key), key, "left_anti")
    return found


def with_signals(repos: DataFrame, coauthors: DataFrame, topics: DataFrame, cursor: DataFrame) -> DataFrame:
    """Signals of each source by repository: the list of co-author marks, and two flags."""
    marks = coauthors.groupBy("repo").agg(F.sort_array(F.collect_list("signal")).alias("coauthor_signals"))
    flag = lambda df, name: df.select("repo", F.lit(True).alias(name)).distinct()
    joined = repos.join(marks, "repo", "left").join(flag(topics, "has_topic_match"), "repo", "left").join(flag(cursor, "has_cursorrules"), "repo", "left")
    return joined.na.fill(False, ["has_topic_match", "has_cursorrules"])


def add_new(listed: DataFrame, found: DataFrame, key: str = "repo", order: str = "ord") -> DataFrame:
    """The list, then what it doesn't have yet, in order."""
    fresh = found.join(listed.select(key), key, "left_anti")
    last = listed.agg(F.coalesce(F.max(order), F.lit(-1)).alias("last"))
    n = numbered(fresh.select(key, order), [order, key], "n")
    return listed.select(key, order).unionByName(n.crossJoin(F.broadcast(last)).select(key, (F.col("last") + F.col("n")).cast("int").alias(order)))
