"""Subscriptions, codes, companies and seats. Expiry rules take the present as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("active", "trialing", "past_due")


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def subscription_overview(subscriptions: DataFrame, user_subscriptions: DataFrame, prices: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """One row for each subscription that either table knows."""
    s, us = subscriptions.alias("s"), user_subscriptions.alias("us")
    pr = prices.select(F.col("id").alias("price_key"), "product_id", F.col("unit_amount").alias("price_amount"), "billing_interval")
    p = products.select(F.col("id").alias("product_key"), F.col("name").alias("product_name"), F.col("description").alias("product_description"))
    c = customers.select(F.col("id").alias("customer_key"), F.col("stripe_customer_id").alias("customer"))
    c = c.dropDuplicates(["customer_key"])
    both = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"us.{b}"))
    j = s.join(us, F.col("s.id") == F.col("us.stripe_subscription_id"), "full_outer").join(pr, F.col("s.price_id") == F.col("price_key"), "left").join(p, F.col("product_id") == F.col("product_key"), "left")
    j = j.join(c, both("user_id", "user_id") == F.col("customer_key"), "left")
    start, updated = F.col("s.current_period_start"), F.col("us.updated_at")
    return j.select(
        F.coalesce("s.id", "us.stripe_subscription_id", F.col("us.id").cast("string")).alias("subscription_id"),
        both("id", "stripe_subscription_id").alias("stripe_subscription_id"),
        F.col("us.id").alias("database_id"),
        both("user_id", "user_id").alias("user_id"),
        F.lit("individual").alias("subscription_type"),
        both("status", "status").alias("status"),
        "us.plan_name",
        "us.plan_price",
        "s.price_id",
        "product_name",
        "product_description",
        "price_amount",
        "billing_interval",
        F.coalesce("customer", "us.stripe_customer_id").alias("stripe_customer_id"),
        both("current_period_start", "current_period_start").alias("current_period_start"),
        both("current_period_end", "current_period_end").alias("current_period_end"),
        both("cancel_at_period_end", "cancel_at_period_end").alias("cancel_at_period_end"),
        both("max_documents", "max_documents").alias("max_documents"),
        both("max_questions", "max_questions").alias("max_questions"),
        F.coalesce("s.documents_uploaded", "us.documents_uploaded", F.lit(0)).alias("documents_uploaded"),
        F.coalesce("s.questions_asked", "us.questions_asked", F.lit(0)).alias("questions_asked"),
        both("created", "created_at").alias("created_at"),
        F.greatest(F.coalesce(start, updated), F.coalesce(updated, start)).alias("updated_at"),
        F.when(F.col("s.id").isNotNull(), "subscriptions").when(F.col("us.id").isNotNull(), "user_subscriptions").otherwise("unknown").alias("source_table"),
    )


def active_of_user(overview: DataFrame) -> DataFrame:
    """Each user's newest live subscription."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "subscription_id")
    return overview.where(F.col("status").isin(*LIVE)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def migrated(user_subscriptions: DataFrame, subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Old rows that the new table doesn't have yet, in its form."""
    new = user_subscriptions.where("stripe_subscription_id IS NOT NULL").join(subscriptions.select(F.col("id").alias("stripe_subscription_id")), "stripe_subscription_id", "left_anti")
    return new.select(
        F.col("stripe_subscription_id").alias("id"),
        "user_id",
        F.when(F.col("status").isin("cancelled", "suspended"), "canceled").otherwise(F.col("status")).alias("status"),
        F.lit(1).alias("quantity"),
        F.coalesce("cancel_at_period_end", F.lit(False)).alias("cancel_at_period_end"),
        F.coalesce("created_at", at(as_of)).alias("created"),
        F.coalesce("current_period_start", "created_at", at(as_of)).alias("current_period_start"),
        F.coalesce("current_period_end", F.col("created_at") + F.expr("INTERVAL 1 MONTH"), at(as_of) + F.expr("INTERVAL 1 MONTH")).alias("current_period_end"),
    )


def access_levels(users: DataFrame, user_subscriptions: DataFrame, redemptions: DataFrame, as_of: str) -> DataFrame:
    """user_id, has_active, access_level: a paid plan, else a code's trial, else free."""
    paid = user_subscriptions.where((F.col("status") == "active") & (F.col("current_period_end") > at(as_of)))
    paid = paid.groupBy("user_id").agg(F.min_by("plan_name", "id").alias("plan"))
    trial = redemptions.where(F.col("is_active") & (F.col("access_granted_until") > at(as_of)) & ~F.col("expired")).select("user_id").distinct().withColumn("trial", F.lit(True))
    j = users.select(F.col("id").alias("user_id")).join(paid, "user_id", "left").join(trial, "user_id", "left")
    level = F.when(F.col("plan") == "professional", "professional").when(F.col("plan").isNotNull(), "individual").when(F.col("trial"), "trial").otherwise("free")
    return j.select("user_id", (F.col("plan").isNotNull() | F.col("trial").isNotNull()).alias("has_active"), level.alias("access_level"))


def account_types(profiles: DataFrame, companies: DataFrame, subscriptions: DataFrame, as_of: str) -> DataFrame:
    """The effective account type, by ordered rules."""
    c = companies.select(F.col("id").alias("company_id"), (F.col("status") == "active").alias("company_active"))
    paid = subscriptions.where(F.col("status").isin(*LIVE) & (F.col("current_period_end") > at(as_of))).select(F.col("user_id").alias("id")).distinct().withColumn("paid", F.lit(True))
    j = profiles.join(c, "company_id", "left").join(paid, "id", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    source = F.coalesce("subscription_source", F.lit(""))
    expired = (source == "passcode") & F.coalesce(F.col("access_expires_at") <= at(as_of), F.lit(False))
    rule = (
        F.when(expired, "sole")
        .when((source == "company") & yes("company_active"), "professional")
        .when((source == "company") & ~yes("company_active") & ~yes("paid"), "sole")
        .when((F.col("account_type") == "sole") & yes("paid"), "professional")
        .when((F.col("account_type") == "professional") & ~source.isin("passcode", "company") & ~yes("paid"), "sole")
        .otherwise(F.col("account_type"))
    )
    return j.select(F.col("id").alias("user_id"), rule.alias("effective_type"))


def redeem(attempts: DataFrame, codes: DataFrame, kind: str) -> DataFrame:
    """The outcome of each attempt(id, code, user_id, ts), in order of time, for kind 'passcode' or 'access'.

    Uses are counted by attempts that succeed. A user's later attempts at a code are refused as used before;
    of the others, those before the limit succeed, by rank. Attempts of one code are ranked in one window.
    """
    fold = (lambda c: F.upper(c)) if kind == "passcode" else (lambda c: c)
    a = attempts.withColumn("key", F.nullif(F.trim("code"), F.lit("")))
    c = codes.select(F.col("id").alias("code_id"), fold(F.col("code")).alias("code_key"), "is_active", "max_uses", "valid_from", "valid_until", "duration_months", "duration_days")
    j = a.join(c, fold(F.col("key")) == F.col("code_key"), "left")
    late = F.coalesce(F.col("ts") > F.col("valid_until"), F.lit(False))
    early = F.coalesce(F.col("ts") < F.col("valid_from"), F.lit(False)) if kind == "passcode" else F.lit(False)
    bad = F.when(F.col("key").isNull(), "required").when(F.col("code_id").isNull(), "not_found").when(~F.col("is_active"), "inactive")
    open_ = bad.isNull() & ~late & ~early
    j = j.withColumn("bad", bad).withColumn("late", late).withColumn("early", early).withColumn("open", open_)
    by_user = Window.partitionBy("code_id", "user_id", "open").orderBy("ts", "id")
    j = j.withColumn("nth", F.row_number().over(by_user)).withColumn("first", F.col("open") & (F.col("nth") == 1))
    by_code = Window.partitionBy("code_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("before", F.coalesce(F.sum(F.col("first").cast("long")).over(by_code), F.lit(0)))
    # no more than max_uses of the first attempts succeed, so the uses so far are the lesser of both
    full = F.least("before", "max_uses") >= F.col("max_uses")
    if kind == "passcode":
        reason = F.when(F.col("bad").isNotNull(), F.col("bad")).when(full, "used_up").when(F.col("early"), "not_yet_valid").when(F.col("late"), "expired").when(F.col("nth") > 1, "already_used").otherwise("ok")
        until = F.col("ts") + F.make_interval(months=F.col("duration_months"))
    else:
        reason = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("late"), "expired").when(full, "used_up").when(F.col("nth") > 1, "already_used").otherwise("ok")
        until = F.col("ts") + F.make_interval(days=F.col("duration_days"))
    return j.select("id", reason.alias("reason"), F.when(reason == "ok", until).alias("access_until"))


def swept(redemptions: DataFrame, as_of: str) -> DataFrame:
    """Redemptions after the expiry sweep, with the rows that it changed."""
    hit = (F.col("access_granted_until") < at(as_of)) & ~F.col("expired")
    return redemptions.select("id", (F.col("expired") | hit).alias("expired"), (F.col("is_active") & ~hit).alias("is_active"), hit.alias("changed"))


def uploader_company(memberships: DataFrame, companies: DataFrame) -> DataFrame:
    """user_id, company_id: active companies before pending ones, the newest seat first, unknown dates last."""
    j = memberships.where("status = 'active'").join(companies.where(F.col("status").isin("pending", "active")).select(F.col("id").alias("company_id"), F.col("status").alias("company_status")), "company_id")
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("company_status") == "active", 0).otherwise(1), F.col("joined_at").desc_nulls_last(), "company_id")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "company_id")


def latest_pending_company(companies: DataFrame, subscription_id: str, as_of: str, days: int = 14) -> DataFrame:
    """owner_user_id, company_id: the newest pending company of each owner that this subscription may activate."""
    ok = companies.where((F.col("status") == "pending") & (F.col("subscription_id").isNull() | (F.col("subscription_id") == subscription_id)) & (F.col("created_at") > at(as_of) - F.expr(f"INTERVAL {days} DAYS")))
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("created_at"), "id")
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").select("owner_user_id", F.col("id").alias("company_id"))


def join_companies(attempts: DataFrame, companies: DataFrame, memberships: DataFrame) -> DataFrame:
    """The outcome of each attempt(id, user_id, code, ts) to join: at most one attempt for each user.

    Seats go in order of time to those who may join; who asks when none is left is refused.
    """
    seats = memberships.where("status = 'active'")
    code = F.nullif(F.upper(F.trim("code")), F.lit(""))
    c = companies.select(F.col("id").alias("company_id"), F.upper("join_code").alias("key"), F.col("status").alias("company_status"), "max_seats")
    j = attempts.withColumn("key", code).join(c, "key", "left")
    mine = seats.select("company_id", "user_id", F.lit(True).alias("member"))
    elsewhere = seats.join(companies.where("status = 'active'").select(F.col("id").alias("company_id")), "company_id").select("user_id", F.col("company_id").alias("other"))
    used = seats.groupBy("company_id").agg(F.count("*").alias("used"))
    j = j.join(mine, ["company_id", "user_id"], "left").join(used, "company_id", "left")
    other = j.select("id", "user_id", "company_id").join(elsewhere, "user_id").where(~F.col("other").eqNullSafe(F.col("company_id"))).select("id").distinct().withColumn("taken", F.lit(True))
    j = j.join(other, "id", "left")
    early = F.when(F.col("key").isNull(), "required").when(F.col("company_id").isNull(), "invalid").when(F.col("company_status") != "active", "not_active").when(F.col("member"), "already_member").when(F.col("taken"), "other_company")
    j = j.withColumn("early", early)
    w = Window.partitionBy("company_id", F.col("early").isNull()).orderBy("ts", "id")
    rank = F.row_number().over(w)
    return j.select("id", F.coalesce("early", F.when(rank + F.coalesce("used", F.lit(0)) > F.col("max_seats"), "no_seats").otherwise("joined")).alias("outcome"))


def plan_label(max_seats: Column) -> Column:
    return F.when(max_seats.isNull(), "Company").when(max_seats <= 25, "Small company").otherwise("Large company")


def company_status(payment_status: Column) -> Column:
    return F.when(payment_status.isin(*LIVE), "active").when(payment_status.isin("canceled", "cancelled", "unpaid", "incomplete_expired"), "inactive").otherwise("pending")


def allowance(remaining: Column, most: int) -> tuple[Column, Column, Column]:
    """used, remaining after clamping, remaining after one more upload"""
    left = F.least(F.greatest(F.coalesce(remaining, F.lit(most)), F.lit(0)), F.lit(most))
    return F.greatest(F.lit(0), F.lit(most) - left), left, F.greatest(left - 1, F.lit(0))


def within_limit(limit: Column, used: Column) -> Column:
    return limit.isNull() | (used < limit)


def diagnose_sharing(companies: DataFrame, memberships: DataFrame, profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """issue, severity, company_id, document_id, user_id: the four checks after each other."""
    null = F.lit(None).cast("long")
    row = lambda issue, severity, company, document, user: [F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), company.alias("company_id"), document.alias("document_id"), user.alias("user_id")]
    c = companies.select(F.col("id").alias("company_id"), F.col("status").alias("company_status"), "owner_user_id")
    seats = memberships.where("status = 'active'").select("company_id", "user_id", F.col("role").alias("seat_role"))
    p = profiles.select(F.col("id").alias("user_id"), F.col("company_id").alias("profile_company"))
    loose = docs.where(F.col("company_id").isNull() & ~F.coalesce("is_shared_library", F.lit(False))).select(F.col("id").alias("document_id"), F.col("user_id").alias("uploader"))
    one = c.where(~F.col("company_status").eqNullSafe("active")).select(*row("company_not_active", "high", F.col("company_id"), null, null))
    two = seats.join(c.where("company_status = 'active'"), "company_id").join(p, "user_id").where(~F.col("profile_company").eqNullSafe(F.col("company_id")))
    two = two.select(*row("member_profile_company_mismatch", "medium", F.col("company_id"), null, F.col("user_id")))
    three = loose.join(seats, F.col("uploader") == F.col("user_id")).join(c.where(F.col("company_status").isin("pending", "active")), "company_id").join(p, "user_id")
    three = three.select(*row("document_missing_company_id", "high", F.col("company_id"), F.col("document_id"), F.col("user_id")))
    owners = profiles.select(F.col("id").alias("owner_user_id"))
    unstamped = loose.groupBy(F.col("uploader").alias("owner_user_id")).agg(F.count("*").alias("n"))
    four = seats.where("seat_role = 'member'").join(c.where("company_status = 'active'"), "company_id").join(p, "user_id").join(owners, "owner_user_id").join(unstamped, "owner_user_id").where("n > 0")
    four = four.select(*row("seat_cannot_see_owner_docs", "high", F.col("company_id"), null, F.col("user_id"))).distinct()
    return one.unionByName(two).unionByName(three).unionByName(four)


def attached_documents(docs: DataFrame, memberships: DataFrame, companies: DataFrame) -> DataFrame:
    """company_id, documents_attached: own, unshared, unstamped documents of each live company's active members."""
    live = companies.where(F.col("status").isin("pending", "active")).select(F.col("id").alias("company_id"))
    loose = docs.where(F.col("company_id").isNull() & ~F.coalesce("is_shared_library", F.lit(False))).select(F.col("id").alias("document_id"), "user_id")
    seats = memberships.where("status = 'active'").select("company_id", "user_id").distinct()
    counts = loose.join(seats, "user_id").groupBy("company_id").agg(F.count_distinct("document_id").alias("n"))
    return live.join(counts, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).cast("long").alias("documents_attached"))
