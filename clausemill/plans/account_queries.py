"""Subscriptions, codes, companies and seats."""

from pyspark.sql import functions as F

from clausemill.operators import accounts as a
from clausemill.sources.derived import AS_OF

from .registry import query

_OVERVIEW = """
    SELECT coalesce(s.id, us.stripe_subscription_id, us.id::VARCHAR) AS subscription_id, coalesce(s.id, us.stripe_subscription_id) AS stripe_subscription_id, us.id AS database_id,
      coalesce(s.user_id, us.user_id) AS user_id, 'individual' AS subscription_type, coalesce(s.status, us.status) AS status, us.plan_name, us.plan_price, s.price_id,
      p.name AS product_name, p.description AS product_description, pr.unit_amount AS price_amount, pr.billing_interval,
      coalesce((SELECT stripe_customer_id FROM customers c WHERE c.id = coalesce(s.user_id, us.user_id)), us.stripe_customer_id) AS stripe_customer_id,
      coalesce(s.current_period_start, us.current_period_start) AS current_period_start, coalesce(s.current_period_end, us.current_period_end) AS current_period_end,
      coalesce(s.cancel_at_period_end, us.cancel_at_period_end) AS cancel_at_period_end, coalesce(s.max_documents, us.max_documents) AS max_documents,
      coalesce(s.max_questions, us.max_questions)::INT AS max_questions, coalesce(s.documents_uploaded, us.documents_uploaded, 0) AS documents_uploaded,
      coalesce(s.questions_asked, us.questions_asked, 0) AS questions_asked, coalesce(s.created, us.created_at) AS created_at,
      greatest(coalesce(s.current_period_start, us.updated_at), coalesce(us.updated_at, s.current_period_start)) AS updated_at,
      CASE WHEN s.id IS NOT NULL THEN 'subscriptions' WHEN us.id IS NOT NULL THEN 'user_subscriptions' ELSE 'unknown' END AS source_table
    FROM subscriptions s FULL OUTER JOIN user_subscriptions us ON s.id = us.stripe_subscription_id LEFT JOIN prices pr ON s.price_id = pr.id LEFT JOIN products p ON pr.product_id = p.id"""
_LIVE = "('active', 'trialing', 'past_due')"


def _overview(v):
    return a.subscription_overview(v.subscriptions, v.user_subscriptions, v.prices, v.products, v.customers)


@query("B1_subscription_overview", _OVERVIEW)
def _(v):
    return _overview(v)


@query("B2_active_subscriptions", f"WITH o AS ({_OVERVIEW}) SELECT subscription_id, status FROM o WHERE status IN {_LIVE}")
def _(v):
    return _overview(v).where(F.col("status").isin(*a.LIVE)).select("subscription_id", "status")


@query("B3_subscription_details", f"WITH o AS ({_OVERVIEW}) SELECT subscription_id, o.user_id, email, full_name, pf.role FROM o LEFT JOIN profiles pf ON pf.id = o.user_id")
def _(v):
    p = v.profiles.select(F.col("id").alias("user_id"), "email", "full_name", "role")
    return _overview(v).join(p, "user_id", "left").select("subscription_id", "user_id", "email", "full_name", "role")


@query("J8_overview_profiles", f"WITH o AS ({_OVERVIEW}) SELECT subscription_id, source_table, account_type FROM o LEFT JOIN profiles pf ON pf.id = o.user_id")
def _(v):
    p = v.profiles.select(F.col("id").alias("user_id"), "account_type")
    return _overview(v).join(p, "user_id", "left").select("subscription_id", "source_table", "account_type")


@query("J22_list_with_details", f"WITH o AS ({_OVERVIEW}) SELECT s.id AS subscription_id, o.plan_name, o.product_name FROM subscriptions s LEFT JOIN o ON o.subscription_id = s.id")
def _(v):
    o = _overview(v).select("subscription_id", "plan_name", "product_name")
    return v.subscriptions.select(F.col("id").alias("subscription_id")).join(o, "subscription_id", "left")


@query("B4_user_active_subscription", f"WITH o AS ({_OVERVIEW}) SELECT user_id, subscription_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id) AS n FROM o WHERE status IN {_LIVE}) WHERE n = 1")
def _(v):
    return a.active_of_user(_overview(v)).select("user_id", "subscription_id", "status")


@query("W6_newest_active", f"WITH o AS ({_OVERVIEW}) SELECT user_id, created_at, subscription_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id) AS n FROM o WHERE status IN {_LIVE}) WHERE n = 1")
def _(v):
    return a.active_of_user(_overview(v)).select("user_id", "created_at", "subscription_id")


@query("B5_all_subscriptions", f"WITH o AS ({_OVERVIEW}) SELECT subscription_id, user_id, created_at FROM o ORDER BY created_at DESC, subscription_id")
def _(v):
    return _overview(v).select("subscription_id", "user_id", "created_at").orderBy(F.desc("created_at"), "subscription_id")


@query("B6_migrate_subscriptions", f"""SELECT stripe_subscription_id AS id, user_id, CASE WHEN status IN ('cancelled', 'suspended') THEN 'canceled' ELSE status END AS status, 1 AS quantity,
    coalesce(cancel_at_period_end, false) AS cancel_at_period_end, coalesce(created_at, TIMESTAMP '{AS_OF}') AS created, coalesce(current_period_start, created_at, TIMESTAMP '{AS_OF}') AS current_period_start,
    coalesce(current_period_end, created_at + INTERVAL 1 MONTH, TIMESTAMP '{AS_OF}' + INTERVAL 1 MONTH) AS current_period_end
    FROM user_subscriptions WHERE stripe_subscription_id IS NOT NULL AND stripe_subscription_id NOT IN (SELECT id FROM subscriptions)""")
def _(v):
    return a.migrated(v.user_subscriptions, v.subscriptions, AS_OF)


@query("J5_subscriptions_full_outer", "SELECT s.id AS new_id, us.id AS old_id FROM subscriptions s FULL OUTER JOIN user_subscriptions us ON s.id = us.stripe_subscription_id")
def _(v):
    s, u = v.subscriptions.select(F.col("id").alias("new_id")), v.user_subscriptions.select(F.col("id").alias("old_id"), "stripe_subscription_id")
    return s.join(u, F.col("new_id") == F.col("stripe_subscription_id"), "full_outer").select("new_id", "old_id")


@query("J6_price_product", "SELECT s.id, pr.billing_interval, p.name FROM subscriptions s LEFT JOIN prices pr ON pr.id = s.price_id LEFT JOIN products p ON p.id = pr.product_id")
def _(v):
    pr = v.prices.select(F.col("id").alias("price_id"), "product_id", "billing_interval")
    p = v.products.select(F.col("id").alias("product_id"), "name")
    return v.subscriptions.select("id", "price_id").join(pr, "price_id", "left").join(p, "product_id", "left").select("id", "billing_interval", "name")


@query("J7_customer_lookup", "SELECT us.id, coalesce((SELECT stripe_customer_id FROM customers c WHERE c.id = us.user_id), us.stripe_customer_id) AS customer FROM user_subscriptions us")
def _(v):
    c = v.customers.select(F.col("id").alias("user_id"), F.col("stripe_customer_id").alias("found")).dropDuplicates(["user_id"])
    return v.user_subscriptions.join(c, "user_id", "left").select("id", F.coalesce("found", "stripe_customer_id").alias("customer"))


@query("J9_not_in", "SELECT id FROM user_subscriptions WHERE stripe_subscription_id IS NOT NULL AND stripe_subscription_id NOT IN (SELECT id FROM subscriptions)")
def _(v):
    return v.user_subscriptions.where("stripe_subscription_id IS NOT NULL").join(v.subscriptions.select(F.col("id").alias("stripe_subscription_id")), "stripe_subscription_id", "left_anti").select("id")


_PAID = f"(SELECT user_id, arg_min(plan_name, id) AS plan FROM user_subscriptions WHERE status = 'active' AND current_period_end > TIMESTAMP '{AS_OF}' GROUP BY user_id)"
_TRIAL = f"(SELECT DISTINCT user_id, true AS trial FROM redemptions WHERE is_active AND access_granted_until > TIMESTAMP '{AS_OF}' AND NOT expired)"


@query("B7_has_active_subscription", f"SELECT p.id AS user_id, a.plan IS NOT NULL OR t.trial IS NOT NULL AS has_active FROM profiles p LEFT JOIN {_PAID} a ON a.user_id = p.id LEFT JOIN {_TRIAL} t ON t.user_id = p.id")
def _(v):
    return a.access_levels(v.profiles, v.user_subscriptions, v.redemptions, AS_OF).select("user_id", "has_active")


@query("B8_access_level", f"SELECT p.id AS user_id, CASE WHEN a.plan = 'professional' THEN 'professional' WHEN a.plan IS NOT NULL THEN 'individual' WHEN t.trial THEN 'trial' ELSE 'free' END AS access_level FROM profiles p LEFT JOIN {_PAID} a ON a.user_id = p.id LEFT JOIN {_TRIAL} t ON t.user_id = p.id")
def _(v):
    return a.access_levels(v.profiles, v.user_subscriptions, v.redemptions, AS_OF).select("user_id", "access_level")


@query("B9_effective_account_type", f"""WITH paid AS (SELECT DISTINCT user_id FROM subscriptions WHERE status IN {_LIVE} AND current_period_end > TIMESTAMP '{AS_OF}')
    SELECT p.id AS user_id, CASE WHEN coalesce(subscription_source, '') = 'passcode' AND coalesce(access_expires_at <= TIMESTAMP '{AS_OF}', false) THEN 'sole'
      WHEN coalesce(subscription_source, '') = 'company' AND coalesce(c.status = 'active', false) THEN 'professional'
      WHEN coalesce(subscription_source, '') = 'company' AND NOT coalesce(c.status = 'active', false) AND paid.user_id IS NULL THEN 'sole'
      WHEN account_type = 'sole' AND paid.user_id IS NOT NULL THEN 'professional'
      WHEN account_type = 'professional' AND coalesce(subscription_source, '') NOT IN ('passcode', 'company') AND paid.user_id IS NULL THEN 'sole' ELSE account_type END AS effective_type
    FROM profiles p LEFT JOIN companies c ON c.id = p.company_id LEFT JOIN paid ON paid.user_id = p.id""")
def _(v):
    return a.account_types(v.profiles, v.companies, v.subscriptions, AS_OF)


@query("B10_usage_limits", "SELECT id, max_documents IS NULL OR documents_uploaded < max_documents AS may_upload, max_questions IS NULL OR coalesce(questions_asked, 0) < max_questions AS may_ask FROM user_subscriptions")
def _(v):
    return v.user_subscriptions.select("id", a.within_limit(F.col("max_documents"), F.col("documents_uploaded")).alias("may_upload"), a.within_limit(F.col("max_questions"), F.coalesce("questions_asked", F.lit(0))).alias("may_ask"))


def _redeem_sql(kind: str) -> str:
    fold = "upper" if kind == "passcode" else ""
    early = "coalesce(ts < valid_from, false)" if kind == "passcode" else "false"
    unit = "to_months(duration_months)" if kind == "passcode" else "to_days(duration_days)"
    order = "WHEN least(before, max_uses) >= max_uses THEN 'used_up' WHEN early THEN 'not_yet_valid' WHEN late THEN 'expired'" if kind == "passcode" else "WHEN late THEN 'expired' WHEN least(before, max_uses) >= max_uses THEN 'used_up'"
    return f"""WITH j AS (SELECT t.id, t.user_id, t.ts, c.id AS code_id, c.max_uses, {"duration_months" if kind == "passcode" else "duration_days"},
        CASE WHEN nullif(trim(t.code), '') IS NULL THEN 'required' WHEN c.id IS NULL THEN 'not_found' WHEN NOT c.is_active THEN 'inactive' END AS bad,
        coalesce(ts > valid_until, false) AS late, {early} AS early FROM redemption_attempts t LEFT JOIN codes c ON {fold}(trim(t.code)) = {fold}(c.code)),
      k AS (SELECT *, bad IS NULL AND NOT late AND NOT early AS open_, row_number() OVER (PARTITION BY code_id, user_id, bad IS NULL AND NOT late AND NOT early ORDER BY ts, id) AS nth FROM j),
      b AS (SELECT *, coalesce(sum((open_ AND nth = 1)::BIGINT) OVER (PARTITION BY code_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
      r AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad {order} WHEN nth > 1 THEN 'already_used' ELSE 'ok' END AS reason FROM b)
      SELECT id, reason, CASE WHEN reason = 'ok' THEN ts + {unit} END AS access_until FROM r"""


@query("B11_redeem_passcode", _redeem_sql("passcode"))
def _(v):
    return a.redeem(v.redemption_attempts, v.codes, "passcode")


@query("B12_redeem_access_code", _redeem_sql("access"))
def _(v):
    return a.redeem(v.redemption_attempts, v.codes, "access")


@query("B13_expiry_sweep", f"SELECT id, expired OR (access_granted_until < TIMESTAMP '{AS_OF}' AND NOT expired) AS expired, is_active AND NOT (access_granted_until < TIMESTAMP '{AS_OF}' AND NOT expired) AS is_active, access_granted_until < TIMESTAMP '{AS_OF}' AND NOT expired AS changed FROM redemptions")
def _(v):
    return a.swept(v.redemptions, AS_OF)


@query("B14_usage_counters", "SELECT code_id, count(*) AS times_used FROM redemptions GROUP BY code_id")
def _(v):
    return v.redemptions.groupBy("code_id").agg(F.count("*").alias("times_used"))


@query("A12_redemption_stats", "SELECT count(*) AS total, count(*) FILTER (is_active AND NOT expired) AS active, count(*) FILTER (expired) AS expired FROM redemptions")
def _(v):
    return v.redemptions.agg(F.count("*").alias("total"), F.count_if(F.col("is_active") & ~F.col("expired")).alias("active"), F.count_if("expired").alias("expired"))


_JOINERS = "(SELECT id, (id + 3) % 60 AS user_id, concat(CASE WHEN id % 2 = 0 THEN 'join' ELSE 'JOIN' END, CAST(id % 5 AS VARCHAR)) AS code, ts FROM redemption_attempts)"


@query("B15_join_company", f"""WITH seats AS (SELECT * FROM memberships WHERE status = 'active'), used AS (SELECT company_id, count(*) AS used FROM seats GROUP BY company_id),
    j AS (SELECT t.id, t.ts, c.id AS company_id, c.max_seats, coalesce(used, 0) AS used, CASE WHEN nullif(upper(trim(t.code)), '') IS NULL THEN 'required' WHEN c.id IS NULL THEN 'invalid' WHEN c.status <> 'active' THEN 'not_active'
        WHEN EXISTS (SELECT 1 FROM seats s WHERE s.company_id = c.id AND s.user_id = t.user_id) THEN 'already_member'
        WHEN EXISTS (SELECT 1 FROM seats s JOIN companies o ON o.id = s.company_id AND o.status = 'active' WHERE s.user_id = t.user_id AND o.id IS DISTINCT FROM c.id) THEN 'other_company' END AS early
      FROM {_JOINERS} t LEFT JOIN companies c ON upper(c.join_code) = upper(trim(t.code)) LEFT JOIN used ON used.company_id = c.id)
    SELECT id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY company_id, early IS NULL ORDER BY ts, id) + used > max_seats THEN 'no_seats' ELSE 'joined' END) AS outcome FROM j""")
def _(v):
    t = v.redemption_attempts.select("id", ((F.col("id") + 3) % 60).alias("user_id"), F.concat(F.when(F.col("id") % 2 == 0, "join").otherwise("JOIN"), (F.col("id") % 5).cast("string")).alias("code"), "ts")
    return a.join_companies(t, v.companies, v.memberships)


@query("B16_activate_pending_company", f"SELECT owner_user_id, id AS company_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY created_at DESC, id) AS n FROM companies WHERE status = 'pending' AND (subscription_id IS NULL OR subscription_id = 'sub1') AND created_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY) WHERE n = 1")
def _(v):
    return a.latest_pending_company(v.companies, "sub1", "2024-01-20 00:00:00")


@query("W8_latest_pending", f"SELECT owner_user_id, id AS company_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY created_at DESC, id) AS n FROM companies WHERE status = 'pending' AND subscription_id IS NULL AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) WHERE n = 1")
def _(v):
    return a.latest_pending_company(v.companies, "none", AS_OF)


_UPLOADER = "SELECT user_id, company_id FROM (SELECT m.user_id, m.company_id, row_number() OVER (PARTITION BY m.user_id ORDER BY CASE WHEN c.status = 'active' THEN 0 ELSE 1 END, m.joined_at DESC NULLS LAST, m.company_id) AS n FROM memberships m JOIN companies c ON c.id = m.company_id WHERE m.status = 'active' AND c.status IN ('pending', 'active')) WHERE n = 1"


@query("W7_uploader_company", _UPLOADER)
def _(v):
    return a.uploader_company(v.memberships, v.companies)


@query("B21_company_of_user", f"WITH u AS ({_UPLOADER}) SELECT p.id AS user_id, u.company_id FROM profiles p LEFT JOIN u ON u.user_id = p.id")
def _(v):
    return v.profiles.select(F.col("id").alias("user_id")).join(a.uploader_company(v.memberships, v.companies), "user_id", "left")


@query("B17_attach_documents", "SELECT c.id AS company_id, count(DISTINCT d.id) AS documents_attached FROM companies c LEFT JOIN memberships m ON m.company_id = c.id AND m.status = 'active' LEFT JOIN docs d ON d.user_id = m.user_id AND d.company_id IS NULL AND NOT coalesce(d.is_shared_library, false) WHERE c.status IN ('pending', 'active') GROUP BY c.id")
def _(v):
    return a.attached_documents(v.docs, v.memberships, v.companies)


_V14 = "SELECT 'company_not_active' AS issue, 'high' AS severity, id AS company_id, NULL::BIGINT AS document_id, NULL::BIGINT AS user_id FROM companies WHERE status IS DISTINCT FROM 'active'"
_V15 = "SELECT 'member_profile_company_mismatch' AS issue, 'medium' AS severity, c.id AS company_id, NULL::BIGINT AS document_id, m.user_id FROM memberships m JOIN companies c ON c.id = m.company_id JOIN profiles p ON p.id = m.user_id WHERE m.status = 'active' AND c.status = 'active' AND p.company_id IS DISTINCT FROM m.company_id"
_V16 = """SELECT 'document_missing_company_id' AS issue, 'high' AS severity, c.id AS company_id, d.id AS document_id, d.user_id FROM docs d JOIN memberships m ON m.user_id = d.user_id AND m.status = 'active' JOIN companies c ON c.id = m.company_id AND c.status IN ('pending', 'active') JOIN profiles p ON p.id = d.user_id WHERE d.company_id IS NULL AND NOT coalesce(d.is_shared_library, false)
    UNION ALL SELECT DISTINCT 'seat_cannot_see_owner_docs', 'high', c.id, NULL::BIGINT, m.user_id FROM memberships m JOIN companies c ON c.id = m.company_id JOIN profiles p ON p.id = m.user_id JOIN profiles o ON o.id = c.owner_user_id JOIN docs d ON d.user_id = c.owner_user_id AND d.company_id IS NULL AND NOT coalesce(d.is_shared_library, false) WHERE m.status = 'active' AND m.role = 'member' AND c.status = 'active'"""


def _diagnosis(v):
    return a.diagnose_sharing(v.companies, v.memberships, v.profiles, v.docs)


for _name, _sql, _issues in (
    ("B18_diagnose_sharing", f"{_V14} UNION ALL {_V15} UNION ALL {_V16}", None),
    ("U5_bag_union", f"SELECT issue, count(*) AS n FROM ({_V14} UNION ALL {_V15} UNION ALL {_V16}) GROUP BY issue", "count"),
    ("V14_company_not_active", _V14, ["company_not_active"]),
    ("V15_profile_company_mismatch", _V15, ["member_profile_company_mismatch"]),
    ("V16_document_company_missing", _V16, ["document_missing_company_id", "seat_cannot_see_owner_docs"]),
):

    @query(_name, _sql)
    def _(v, issues=_issues):
        d = _diagnosis(v)
        if issues == "count":
            return d.groupBy("issue").agg(F.count("*").alias("n"))
        return d if issues is None else d.where(F.col("issue").isin(*issues))


@query("J16_missing_company_join", "SELECT d.id AS document_id, c.id AS company_id, p.email, po.email AS owner_email FROM docs d JOIN memberships m ON m.user_id = d.user_id AND m.status = 'active' JOIN companies c ON c.id = m.company_id AND c.status IN ('pending', 'active') JOIN profiles p ON p.id = d.user_id LEFT JOIN profiles po ON po.id = c.owner_user_id WHERE d.company_id IS NULL")
def _(v):
    m = v.memberships.where("status = 'active'").select("user_id", "company_id")
    c = v.companies.where(F.col("status").isin("pending", "active")).select(F.col("id").alias("company_id"), "owner_user_id")
    p, po = v.profiles.select(F.col("id").alias("user_id"), "email"), v.profiles.select(F.col("id").alias("owner_user_id"), F.col("email").alias("owner_email"))
    d = v.docs.where("company_id IS NULL").select(F.col("id").alias("document_id"), "user_id")
    return d.join(m, "user_id").join(c, "company_id").join(p, "user_id").join(po, "owner_user_id", "left").select("document_id", "company_id", "email", "owner_email")


_J17 = "SELECT c.id AS company_id, m.user_id, count(*) AS owner_docs FROM memberships m JOIN companies c ON c.id = m.company_id JOIN docs d ON d.user_id = c.owner_user_id AND d.company_id IS NULL WHERE m.status = 'active' GROUP BY c.id, m.user_id HAVING count(*) > {n}"


def _owner_docs(v, n):
    m = v.memberships.where("status = 'active'").select("user_id", "company_id")
    c = v.companies.select(F.col("id").alias("company_id"), "owner_user_id")
    d = v.docs.where("company_id IS NULL").groupBy(F.col("user_id").alias("owner_user_id")).agg(F.count("*").alias("owner_docs"))
    return m.join(c, "company_id").join(d, "owner_user_id").where(F.col("owner_docs") > n).select("company_id", "user_id", "owner_docs")


@query("J17_seat_owner_documents", _J17.format(n=0))
def _(v):
    return _owner_docs(v, 0)


@query("A15_group_having", _J17.format(n=2))
def _(v):
    return _owner_docs(v, 2)


@query("A14_seats_used", "SELECT company_id, count(*) FILTER (status = 'active') AS seats_used FROM memberships GROUP BY company_id")
def _(v):
    return v.memberships.groupBy("company_id").agg(F.count_if(F.col("status") == "active").alias("seats_used"))


@query("A13_partner_summary", "SELECT partner_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'inactive') AS inactive, count(*) AS total FROM companies GROUP BY partner_id")
def _(v):
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return v.companies.groupBy("partner_id").agg(n("active"), n("pending"), n("inactive"), F.count("*").alias("total"))


_LABEL = "CASE WHEN max_seats IS NULL THEN 'Company' WHEN max_seats <= 25 THEN 'Small company' ELSE 'Large company' END"


@query("B19_plan_label", f"SELECT id, {_LABEL} AS plan_label FROM companies")
def _(v):
    return v.companies.select("id", a.plan_label(F.col("max_seats")).alias("plan_label"))


@query("B20_company_status", "SELECT id, CASE WHEN status IN ('active', 'trialing', 'past_due') THEN 'active' WHEN status IN ('canceled', 'cancelled', 'unpaid', 'incomplete_expired') THEN 'inactive' ELSE 'pending' END AS company_status FROM user_subscriptions")
def _(v):
    return v.user_subscriptions.select("id", a.company_status(F.col("status")).alias("company_status"))


_SEATS = "(SELECT company_id, count(*) AS n FROM memberships WHERE status = 'active' GROUP BY company_id)"


def _companies(v):
    seats = v.memberships.where("status = 'active'").groupBy("company_id").agg(F.count("*").alias("seats_used"))
    owner = v.profiles.select(F.col("id").alias("owner_user_id"), F.col("email").alias("owner_email"), F.col("full_name").alias("owner_name"))
    partner = v.region.select(F.col("r_regionkey").cast("long").alias("partner_id"), F.col("r_name").alias("partner_name"))
    j = v.companies.withColumnRenamed("id", "company_id").join(seats, "company_id", "left").join(owner, "owner_user_id", "left").join(partner, "partner_id", "left")
    return j.withColumn("seats_used", F.coalesce("seats_used", F.lit(0))).withColumn("plan_label", a.plan_label(F.col("max_seats")))


@query("J25_partner_dashboard", f"SELECT c.id AS company_id, c.name, c.status, coalesce(s.n, 0) AS seats_used, {_LABEL} AS plan_label, o.email AS owner_email, o.full_name AS owner_name FROM companies c LEFT JOIN {_SEATS} s ON s.company_id = c.id LEFT JOIN profiles o ON o.id = c.owner_user_id WHERE partner_id = 1")
def _(v):
    return _companies(v).where("partner_id = 1").select("company_id", "name", "status", "seats_used", "plan_label", "owner_email", "owner_name")


@query("J26_companies_admin", f"SELECT c.id AS company_id, c.name, coalesce(s.n, 0) AS seats_used, r_name AS partner_name, o.email AS owner_email FROM companies c LEFT JOIN {_SEATS} s ON s.company_id = c.id LEFT JOIN region r ON r.r_regionkey = c.partner_id LEFT JOIN profiles o ON o.id = c.owner_user_id")
def _(v):
    return _companies(v).select("company_id", "name", "seats_used", "partner_name", "owner_email")


@query("A2_subscription_stats", "SELECT count(*) AS total_subscriptions, count(*) FILTER (status = 'active') AS active_subscriptions, count(*) FILTER (status = 'trialing') AS trial_subscriptions, coalesce(sum(plan_price), 0) AS total_revenue, coalesce(sum(CASE WHEN status = 'active' THEN plan_price ELSE 0 END), 0) AS monthly_revenue FROM user_subscriptions")
def _(v):
    active = F.col("status") == "active"
    return v.user_subscriptions.agg(F.count("*").alias("total_subscriptions"), F.count_if(active).alias("active_subscriptions"), F.count_if(F.col("status") == "trialing").alias("trial_subscriptions"), F.coalesce(F.sum("plan_price"), F.lit(0.0)).alias("total_revenue"), F.coalesce(F.sum(F.when(active, F.col("plan_price")).otherwise(0.0)), F.lit(0.0)).alias("monthly_revenue"))


@query("A8_status_and_type_counts", "SELECT 'status' AS kind, status AS key, count(*) AS n FROM user_subscriptions GROUP BY status UNION ALL SELECT 'plan', plan_name, count(*) FROM user_subscriptions GROUP BY plan_name")
def _(v):
    by = lambda kind, c: v.user_subscriptions.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    return by("status", "status").unionAll(by("plan", "plan_name"))


@query("B31_last_payments", "SELECT user_id, id, plan_price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS n FROM user_subscriptions) WHERE n <= 3")
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return v.user_subscriptions.withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "id", "plan_price")


@query("B32_free_allowance", "SELECT id, greatest(0, 3 - least(greatest(coalesce(documents_remaining, 3), 0), 3))::BIGINT AS used, least(greatest(coalesce(documents_remaining, 3), 0), 3)::BIGINT AS remaining, greatest(least(greatest(coalesce(documents_remaining, 3), 0), 3) - 1, 0)::BIGINT AS after_upload FROM profiles")
def _(v):
    used, left, after = a.allowance(F.col("documents_remaining"), 3)
    return v.profiles.select("id", used.cast("long").alias("used"), left.cast("long").alias("remaining"), after.cast("long").alias("after_upload"))


@query("J14_missing_profiles", "SELECT a.id FROM auth_users a LEFT JOIN profiles p ON p.id = a.id WHERE p.id IS NULL")
def _(v):
    return v.auth_users.join(v.profiles.select("id"), "id", "left_anti").select("id")


@query("B30_profile_repair", "SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM profiles q WHERE lower(q.email) = lower(a.email) AND q.id <> a.id) THEN NULL ELSE a.email END AS email, coalesce(nullif(trim(a.meta_name), ''), split_part(a.email, '@', 1)) AS full_name FROM auth_users a LEFT JOIN profiles p ON p.id = a.id WHERE p.id IS NULL")
def _(v):
    new = v.auth_users.join(v.profiles.select("id"), "id", "left_anti")
    taken = v.profiles.select(F.col("id").alias("other"), F.lower("email").alias("taken")).where("taken IS NOT NULL").dropDuplicates(["taken"])
    j = new.join(taken, F.lower("email") == F.col("taken"), "left")
    return j.select("id", F.when(F.col("other").isNull(), F.col("email")).alias("email"), F.coalesce(F.nullif(F.trim("meta_name"), F.lit("")), F.split_part("email", F.lit("@"), F.lit(1))).alias("full_name"))
