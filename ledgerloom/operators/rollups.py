"""Reducers as aggregates: full folds of a ledger that agree with any batching of it, being sums, counts and last values by sequence."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topics(events: DataFrame) -> DataFrame:
    """Per topic (topic, seq, outcome, problem_id, at, event_key): attempts by outcome, the last one, problems and events; an event counts once."""
    once = events.groupBy("event_key").agg(F.min_by(F.struct("topic", "seq", "outcome", "problem_id", "at"), "seq").alias("e")).select("e.*")
    return once.groupBy("topic").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "negative").alias("negative"),
        F.count_if(F.col("outcome") == "positive").alias("positive"),
        F.count_if(F.col("outcome") == "neutral").alias("neutral"),
        F.max_by("outcome", "seq").alias("last_outcome"),
        F.max_by("at", "seq").alias("last_at"),
        F.countDistinct("problem_id").alias("problems"),
    )


def weaknesses(topics: DataFrame) -> DataFrame:
    return topics.where("negative > 0").select("topic", "negative", F.when(F.col("positive") > 0, "improving").otherwise("open").alias("status"), "last_outcome").orderBy(F.desc("negative"), "topic")


def pending_problems(events: DataFrame) -> DataFrame:
    """Problems whose last outcome is not positive."""
    return events.groupBy("problem_id").agg(F.max_by("outcome", "seq").alias("last_outcome")).where("last_outcome <> 'positive'")


def profile(observations: DataFrame) -> DataFrame:
    """Per (dimension, subject) of observations (seq, key, dimension, subject, polarity, source, replaces): the bucket.

    A replaced observation is not active. A negative is closed when, after the last
    one, at least two sources speak positively.
    """
    replaced = observations.where("replaces IS NOT NULL").select(F.col("replaces").alias("key")).distinct()
    active = observations.join(replaced, "key", "left_anti")
    last = active.groupBy("dimension", "subject").agg(F.max(F.when(F.col("polarity") == "negative", F.col("seq"))).alias("last_negative"))
    after = active.join(last, ["dimension", "subject"]).groupBy("dimension", "subject").agg(
        F.first("last_negative").alias("last_negative"),
        F.countDistinct(F.when((F.col("polarity") == "positive") & (F.col("seq") > F.col("last_negative")), F.col("source"))).alias("confirmed"),
        F.count_if(F.col("polarity") == "positive").alias("positives"),
    )
    bucket = F.when(F.col("last_negative").isNull() & (F.col("positives") > 0), "strength").when(F.col("last_negative").isNull(), "neutral").when(F.col("confirmed") >= 2, "closed").otherwise("weakness")
    return after.select("dimension", "subject", bucket.alias("bucket"), "confirmed")


def selected_reviews(reviews: DataFrame) -> DataFrame:
    """The review of highest version of every session, the later one of two equal versions."""
    values = [c for c in reviews.columns if c != "session"]
    return reviews.groupBy("session").agg(F.max_by(F.struct(*values), F.struct("version", "seq")).alias("r")).select("session", "r.*")


def interview_closure(reviews: DataFrame) -> DataFrame:
    """Per question of (session, question, variant, passed): closed when two sessions and two variants have passed."""
    passed = F.col("passed")
    counted = reviews.groupBy("question").agg(F.countDistinct(F.when(passed, F.col("session"))).alias("sessions"), F.countDistinct(F.when(passed, F.col("variant"))).alias("variants"))
    return counted.withColumn("status", F.when((F.col("sessions") >= 2) & (F.col("variants") >= 2), "closed").otherwise("open"))


def first_scores(scores: DataFrame) -> DataFrame:
    """The first score of every question and day."""
    return scores.groupBy("day", "question").agg(F.min_by(F.struct("seq", "score"), "seq").alias("s")).select("day", "question", "s.seq", "s.score")


def mastery(scores: DataFrame, weight: float = 0.6) -> DataFrame:
    """Per question the moving average round2(weight x new + (1 - weight) x old) of its scores in order, seeded with the first.

    It is computed in decimals, scores to four digits, so that halves round up wherever it runs.
    A question has one score a day, so its ordered list is bounded by the days.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "score"))), lambda s: s["score"].cast("decimal(18,4)"))
    new, old = (F.lit(Decimal(str(w))) for w in (weight, round(1 - weight, 10)))

    def fold(acc: Column, x: Column) -> Column:
        return F.when(acc.isNull(), x).otherwise(F.round(new * x + old * acc, 2).cast("decimal(18,4)"))

    return scores.groupBy("question").agg(ordered.alias("scores")).select("question", F.aggregate("scores", F.lit(None).cast("decimal(18,4)"), fold).cast("double").alias("mastery"), F.size("scores").alias("n"))


def coverage(questions: DataFrame, tested: DataFrame) -> DataFrame:
    """How many of the questions have been tested, per group."""
    done = tested.select("question").distinct().withColumn("t", F.lit(1))
    return questions.join(done, "question", "left").groupBy("group").agg(F.count("t").alias("tested"), F.count("*").alias("total"))


def recent(events: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    """The last ``n`` events of every key; Spark's window group limit keeps no more than that of any key in a task."""
    return events.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("r") <= n)


def intent(requests: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per request (intent_key, content_hash): new, replay, alias or conflict against what is known."""
    a = aliases.select("intent_key", F.col("target_key").alias("target"))
    k = known.select(F.col("intent_key").alias("k_key"), F.col("content_hash").alias("k_hash"))
    joined = requests.join(a, "intent_key", "left").join(k, F.coalesce("target", "intent_key") == F.col("k_key"), "left")
    return joined.select("intent_key", F.when(F.col("k_key").isNull(), "new").when(F.col("k_hash") != F.col("content_hash"), "conflict").when(F.col("target").isNotNull(), "alias").otherwise("replay").alias("decision"))
