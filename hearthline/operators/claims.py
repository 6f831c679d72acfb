"""Claim codes: format check and resolution of claims to issued codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import claim_code_ok, interval

CLAIM_TTL = "5 minutes"


def valid_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(claim_code_ok(F.col("code")))


def resolve_claims(codes: DataFrame, claims: DataFrame, ttl: str = CLAIM_TTL) -> DataFrame:
    """Match each claim with the latest live issuance of its code.

    ``codes`` has (issue_id, code, user_id, issued_at), ``claims`` (claim_id,
    code, claimed_at).  An issuance lives for ``ttl`` and is used up by its first
    claim; every other claim is NOT_FOUND.

    Both logs are cut into time slices as long as ``ttl``, so an often used code
    is spread over its slices.  A claim can reach back one slice only, and there
    only to the latest issuance.  That one is handed on, as one row per code and
    slice, unless a claim in its own slice used it up.
    """
    life = interval(ttl)
    issued = codes.filter(F.col("issued_at").isNotNull()).select(
        "code",
        F.window("issued_at", ttl).alias("_slice"),
        F.col("issued_at").alias("_at"),
        F.lit(1).alias("_order"),
        F.struct("issued_at", "issue_id", "user_id").alias("_issue"),
    )
    asked = claims.filter(F.col("claimed_at").isNotNull()).select(
        "code",
        F.window("claimed_at", ttl).alias("_slice"),
        F.col("claimed_at").alias("_at"),
        F.lit(2).alias("_order"),
        "claim_id",
    )
    log = issued.unionByName(asked, allowMissingColumns=True)
    end = F.col("_slice.end")
    handed_on = (
        log.groupBy("code", "_slice")
        .agg(
            F.max("_issue").alias("_issue"),
            F.max(F.when(F.col("_order") == 2, F.col("_at"))).alias("_claimed"),
        )
        .filter(
            F.col("_issue").isNotNull()
            & F.coalesce(F.col("_claimed") < F.col("_issue.issued_at"), F.lit(True))
        )
        .select(
            "code",
            F.struct(end.alias("start"), (end + life).alias("end")).alias("_slice"),
            end.alias("_at"),
            F.lit(0).alias("_order"),
            "_issue",
        )
    )
    in_order = W.partitionBy("code", "_slice").orderBy("_at", "_order", "_issue", "claim_id")
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    timeline = log.unionByName(handed_on, allowMissingColumns=True).withColumns(
        {
            "_live": F.last("_issue", ignorenulls=True).over(so_far),
            # Only the first claim after an issuance can win it.
            "_first": F.coalesce(F.lag("_order").over(in_order) != 2, F.lit(False)),
        }
    )
    won = F.col("_first") & F.coalesce(F.col("_at") < F.col("_live.issued_at") + life, F.lit(False))
    return timeline.filter(F.col("_order") == 2).select(
        "claim_id",
        "code",
        F.col("_at").alias("claimed_at"),
        F.when(won, F.col("_live.issue_id")).alias("issue_id"),
        F.when(won, F.col("_live.user_id")).alias("user_id"),
        F.when(won, "CLAIMED").otherwise("NOT_FOUND").alias("status"),
    )


def claimed_devices(resolved: DataFrame, identities: DataFrame) -> DataFrame:
    """Successful claims joined with the id and token made for each claim.

    ``identities`` has (claim_id, id, device_id, hashed_device_token).
    """
    claimed = resolved.filter("status = 'CLAIMED'").select("claim_id", "user_id")
    return claimed.join(identities, "claim_id").select(
        "id", "device_id", "hashed_device_token", "user_id"
    )
