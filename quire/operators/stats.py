"""Usage statistics and conversation listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admin_statistics(registry: DataFrame, vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of counts; every part is an aggregate of one row."""
    docs = registry.agg(F.countDistinct("doc_id").alias("n"))
    vecs = vectors.agg(F.count(F.lit(1)).alias("n"))
    return messages.agg(
        F.countDistinct("user_id").alias("users_count"),
        F.countDistinct(F.when(F.col("user_role") == "admin", F.col("user_id"))).alias("admin_users_count"),
        F.countDistinct("thread_id").alias("threads_count"),
        F.count(F.lit(1)).alias("messages_count"),
    ).select("*", docs.scalar().alias("documents_count"), vecs.scalar().alias("vector_chunks_count"))


def thread_summary(messages: DataFrame) -> DataFrame:
    """Threads per user with size and last activity."""
    return messages.groupBy("user_id", "thread_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("last_ts"))


def thread_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages of the asked threads, in order."""
    return messages.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").orderBy("thread_id", "seq")


ROLE_LEVELS = {"guest": 1, "user": 2, "admin": 3}


def role_level(role):
    """3 admin, 2 user, 1 guest; null for an unknown role."""
    c = F.when(role == "admin", ROLE_LEVELS["admin"])
    for name in ("user", "guest"):
        c = c.when(role == name, ROLE_LEVELS[name])
    return c


def has_permission(role, required):
    return F.coalesce(role_level(role) >= role_level(required), F.lit(False))


def thread_access(requests: DataFrame, threads: DataFrame) -> DataFrame:
    """Requested threads a user may see: admins all, others their own."""
    r = requests.join(threads.select("thread_id", F.col("user_id").alias("owner")).distinct(), "thread_id")
    return r.where(has_permission(F.col("role"), F.lit("admin")) | (F.col("owner") == F.col("user_id"))).drop("owner")
