"""User reports (Q12: F12, A18, C19) and the new-account batch check."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dims


def user_listing(users: DataFrame) -> DataFrame:
    """Users without any secret column, with the status text and join date."""
    return users.select("id", "name", "email", "role", "is_active",
                        F.when(F.col("is_active"), F.lit("Active")).otherwise(F.lit("Inactive")).alias("status"),
                        F.date_format("created_at", "yyyy-MM-dd").alias("joined"))


def user_search(users: DataFrame, q: str, role: str = "all") -> DataFrame:
    """case-insensitive substring on name OR e-mail, AND role filter."""
    needle = q.lower()
    hit = F.lower("name").contains(needle) | F.lower("email").contains(needle)
    if role != "all":
        hit = hit & (F.col("role") == role)
    return user_listing(users.filter(hit))


def user_roles(spark: SparkSession, users: DataFrame) -> DataFrame:
    """Users per role on the fixed role list (missing roles = 0), other
    roles appended, with the total."""
    counts = users.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    total = users.select(F.count(F.lit(1))).scalar()
    return (dims.role_dim(spark).join(counts, "role", "full")
            .select("role", F.coalesce("n", F.lit(0)).cast("bigint").alias("users"), total.alias("total_users")))


def check_new_accounts(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """What happens to each request if they are handled in the order of ``arrival``.

    missing_fields (empty name or e-mail); else duplicate_email (the e-mail, compared
    exactly, is registered already or was by an earlier accepted request); else
    invalid_role; else accepted.  Only an accepted request claims its e-mail: the first
    valid one by (arrival, request_id).  Requests without an e-mail never enter the joins, so
    blanks are no hot key.
    """
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    missing = blank("name") | blank("email")
    out = ["request_id", "name", "email", "role"]
    whole = requests.filter(~missing)
    valid = F.col("role").isin(dims.ROLES)
    turn = F.struct("arrival", "request_id")
    taken = existing.select("email").distinct().withColumn("_taken", F.lit(True))
    claims = whole.filter(F.coalesce(valid, F.lit(False))).groupBy("email").agg(F.min(turn).alias("_claim"))
    known = whole.join(taken, "email", "left").join(claims, "email", "left")
    status = (F.when(F.col("_taken") | (turn > F.col("_claim")), F.lit("duplicate_email"))
               .when(F.coalesce(valid, F.lit(False)), F.lit("accepted"))
               .otherwise(F.lit("invalid_role")))
    return known.select(*out, status.alias("status")).unionByName(
        requests.filter(missing).select(*out, F.lit("missing_fields").alias("status")))
