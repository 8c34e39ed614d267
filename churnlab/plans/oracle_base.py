"""DuckDB twins of the base tables, as CTE text prefixed to every oracle query.

``policyholders`` re-states FIXTURES.md §1 in plain SQL (window ``lag`` and
``row_number`` are fine here: DuckDB is only the single-node checker). Double
literals are written with an exponent (``0.35e0``) so DuckDB computes in DOUBLE,
as Spark does, instead of DECIMAL.
"""

from __future__ import annotations

POLICYHOLDERS_CTES = """
ph_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_price,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders
),
ph_o AS (
  SELECT o_custkey,
         min_by(o_orderdate, o_orderkey) AS enrol,
         count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '1999-08-01') AS open_orders,
         avg(o_totalprice) FILTER (WHERE o_orderdate >= DATE '1998-05-01') AS cur_avg,
         avg(o_totalprice) FILTER (WHERE o_orderdate < DATE '1998-05-01') AS last_avg,
         count(*) FILTER (WHERE o_orderdate >= DATE '1998-08-01' AND o_totalprice > prev_price) AS increases,
         coalesce(bool_or(rn = 1 AND o_totalprice < 0.5e0 * prev_price), false) AS downgrade,
         count(*) FILTER (WHERE o_orderdate >= DATE '2000-08-01') AS contacts,
         max(CASE WHEN o_orderdate >= DATE '2000-08-01' AND o_orderpriority = '1-URGENT' THEN 1 END) AS complaint,
         count(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate >= DATE '2000-08-01') AS n_prio
  FROM ph_orders GROUP BY o_custkey
),
ph_lines AS (
  SELECT o.o_custkey, l.*,
         (l.l_shipdate >= DATE '2000-08-01' AND l.l_shipdate < DATE '2001-08-01') AS in12,
         (l.l_shipdate >= DATE '2000-08-01' AND l.l_shipdate < DATE '2001-08-01'
          AND l.l_returnflag <> 'N' AND l.l_quantity > 25) AS is_claim
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
ph_l AS (
  SELECT o_custkey,
         sum(l_extendedprice) AS cov,
         count(*) FILTER (WHERE in12 AND l_tax >= 0.065e0) AS late,
         count(*) FILTER (WHERE is_claim) AS claims,
         count(*) FILTER (WHERE is_claim AND l_returnflag = 'A') AS approved,
         count(*) FILTER (WHERE is_claim AND l_returnflag = 'R' AND l_linestatus = 'F') AS rejected,
         count(*) FILTER (WHERE is_claim AND l_returnflag = 'R' AND l_linestatus = 'O') AS pending,
         sum(l_extendedprice) FILTER (WHERE is_claim) AS claim_amt,
         sum(l_extendedprice * (1.0e0 - l_discount)) FILTER (WHERE is_claim AND l_returnflag = 'A') AS payout_amt,
         sum(1 + (l_orderkey + 7 * l_linenumber) % 60) FILTER (WHERE is_claim) AS settle_sum,
         max(l_shipdate) FILTER (WHERE is_claim) AS last_claim,
         max(CASE WHEN in12 AND l_discount >= 0.095e0 THEN 1 END) AS quote
  FROM ph_lines GROUP BY o_custkey
),
ph_1 AS (
  SELECT c.c_custkey AS k,
         c.c_name AS customer_id,
         '2001-08-01' AS as_of_date,
         r.r_name AS region_name,
         CAST(18 + (c.c_custkey * 37) % 63 AS INTEGER) AS age,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Married' ELSE 'Single' END AS marital_status,
         CAST(coalesce((2001 - year(o.enrol)) * 12 + 8 - month(o.enrol), 0) AS INTEGER) AS customer_tenure_months,
         CAST(greatest(1, coalesce(o.open_orders, 0)) AS INTEGER) AS num_policies,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'HOUSEHOLD' THEN 'Home'
              WHEN 'BUILDING' THEN 'Life' WHEN 'MACHINERY' THEN 'Travel' WHEN 'FURNITURE' THEN 'Health' END
           AS policy_type,
         CAST(month(o.enrol) AS INTEGER) AS renewal_month,
         round(o.cur_avg, 6) AS current_premium,
         round(o.last_avg, 6) AS premium_last_year,
         CAST(coalesce(o.increases, 0) AS INTEGER) AS num_price_increases_last_3y,
         round(l.cov, 6) AS coverage_amount,
         CASE WHEN c.c_nationkey % 3 = 0 THEN 'Annual' ELSE 'Monthly' END AS payment_frequency,
         CAST(coalesce(c.c_acctbal > 4500, false) AS INTEGER) AS autopay_enabled,
         CAST(coalesce(l.late, 0) AS INTEGER) AS late_payment_count_12m,
         CAST(coalesce(o.n_prio > 1, false) AS INTEGER) AS payment_method_change_flag,
         CAST(coalesce(l.claims, 0) AS INTEGER) AS num_claims_12m,
         CAST(coalesce(l.approved, 0) AS INTEGER) AS num_approved_claims_12m,
         CAST(coalesce(l.rejected, 0) AS INTEGER) AS num_rejected_claims_12m,
         CAST(coalesce(l.pending, 0) AS INTEGER) AS num_pending_claims_12m,
         round(coalesce(l.claim_amt, 0.0e0), 6) AS total_claim_amount_12m,
         round(coalesce(l.payout_amt, 0.0e0), 6) AS total_payout_amount_12m,
         l.settle_sum,
         CAST(coalesce(date_diff('day', CAST(l.last_claim AS DATE), DATE '2001-08-01'), 365) AS INTEGER)
           AS days_since_last_claim,
         CAST(coalesce(o.contacts, 0) AS INTEGER) AS num_contacts_12m,
         CAST(coalesce(o.complaint, 0) AS INTEGER) AS complaint_flag,
         CAST(coalesce(l.quote, 0) AS INTEGER) AS quote_requested_flag,
         CAST(coalesce(o.downgrade, false) AS INTEGER) AS coverage_downgrade_flag
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN ph_o o ON c.c_custkey = o.o_custkey
  LEFT JOIN ph_l l ON c.c_custkey = l.o_custkey
),
ph_2 AS (
  SELECT *,
         CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
              WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' WHEN age < 75 THEN '65-74'
              ELSE '75+' END AS age_band,
         CAST(num_policies >= 2 AS INTEGER) AS multi_policy_flag,
         round((current_premium - premium_last_year) / nullif(premium_last_year, 0), 6) AS premium_change_pct,
         round(current_premium / nullif(coverage_amount, 0), 6) AS premium_to_coverage_ratio,
         CAST(late_payment_count_12m >= 4 AS INTEGER) AS missed_payment_flag,
         CASE WHEN num_claims_12m > 0 THEN round(total_claim_amount_12m / num_claims_12m, 6) ELSE 0.0e0 END
           AS avg_claim_amount,
         CASE WHEN total_claim_amount_12m > 0 THEN round(total_payout_amount_12m / total_claim_amount_12m, 6)
              ELSE 0.0e0 END AS payout_ratio_12m,
         CASE WHEN num_claims_12m > 0 THEN round(settle_sum / num_claims_12m, 4) ELSE 0.0e0 END
           AS avg_settlement_time_days,
         CAST(CASE WHEN complaint_flag = 1 THEN 1 + k % 30 ELSE 0 END AS INTEGER) AS complaint_resolution_days
  FROM ph_1
),
ph_3 AS (
  SELECT *,
         round(1.0e0 / (1.0e0 + exp(-(
            -2.3e0
            + 2.0e0 * greatest(coalesce(premium_change_pct, 0.0e0), 0.0e0)
            + 0.35e0 * late_payment_count_12m
            + 0.7e0 * complaint_flag
            + 0.6e0 * quote_requested_flag
            + 0.6e0 * coverage_downgrade_flag
            - 0.6e0 * multi_policy_flag
            + 0.7e0 * CAST(customer_tenure_months <= 24 AS INTEGER)))), 6) AS churn_probability_true
  FROM ph_2
),
ph_4 AS (
  SELECT *, CAST(churn_probability_true >= ((k * 7919) % 1000) / 1000.0e0 AS INTEGER) AS churn_flag
  FROM ph_3
),
policyholders AS (
  SELECT customer_id, as_of_date, region_name, age, age_band, marital_status, customer_tenure_months,
         multi_policy_flag, num_policies, policy_type, renewal_month, current_premium, premium_last_year,
         premium_change_pct, num_price_increases_last_3y, coverage_amount, premium_to_coverage_ratio,
         payment_frequency, autopay_enabled, late_payment_count_12m, missed_payment_flag,
         payment_method_change_flag, num_claims_12m, num_approved_claims_12m, num_rejected_claims_12m,
         num_pending_claims_12m, avg_claim_amount, total_claim_amount_12m, total_payout_amount_12m,
         payout_ratio_12m, avg_settlement_time_days, days_since_last_claim, num_contacts_12m, complaint_flag,
         complaint_resolution_days, quote_requested_flag, coverage_downgrade_flag, churn_flag,
         CASE WHEN churn_flag = 0 THEN 'None'
              WHEN premium_change_pct >= 0.12e0 THEN 'Price'
              WHEN late_payment_count_12m >= 2 THEN 'Payment'
              WHEN complaint_flag = 1 THEN 'Service'
              ELSE 'Other' END AS churn_type,
         churn_probability_true
  FROM ph_4
)"""


def with_ctes(body: str, *extra_ctes: str) -> str:
    """Prefix ``body`` with the policyholders CTEs and any extra named CTEs."""
    ctes = [POLICYHOLDERS_CTES.strip()] + [c.strip() for c in extra_ctes if c]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
