"""Oracle SQL. Built from shared WITH lists; everything is computed from the raw tables."""

from __future__ import annotations

from string import Formatter

from holdfast.functions.fixed import DRIFT_ACTIONS, DRIFT_REASONS, HYPOTHESIS_TEXT, ROI_BAD, ROI_GOOD

DAY = 86400000000

TX = """tx as (select cast(o_custkey as varchar) user_id, o_orderdate ts, o_totalprice amount,
  o_orderpriority description, o_orderstatus status from orders)"""
EV = """tx as (select cast(user_id as varchar) user_id, ts, value amount, event_type description,
  case when event_type = 'error' then 1 else 0 end is_failure from events)"""

# per-user features from the raw rows
USERS = f"""
b as (select min(epoch_us(ts)) mn, max(epoch_us(ts)) mx from tx),
rows0 as (select *, epoch_us(ts) us, lag(epoch_us(ts)) over (partition by user_id order by ts) prev from tx),
gaps as (select *, (us - prev) // {DAY} gap from rows0),
u0 as (select user_id, count(*) frequency, sum(amount) monetary, avg(amount) avg_basket_value,
  coalesce(stddev_samp(amount), 0) monetary_std, max(amount) max_spend, min(amount) min_spend,
  min(us) first_us, max(us) last_us, median(gap) med, coalesce(stddev_samp(gap), 0) ipi_std,
  coalesce(max(gap), 0) max_gap from gaps group by user_id),
fillv as (select coalesce(least(quantile_cont(med, 0.5), quantile_cont(med, 0.9)), 30) v from u0),
u1 as (select u0.*, cast((mx + {DAY} - last_us) // {DAY} as double) recency,
  cast(greatest((mx + {DAY} - first_us) // {DAY}, 1) as double) account_age_days,
  cast(coalesce(med, v) as double) ipi_median from u0, b, fillv),
u as (select *, 1 / (1 + ipi_std / 30) ipi_consistency, greatest(recency - ipi_median, 0) recency_deviation,
  greatest(monetary / greatest(account_age_days, 7), 0) monetary_velocity from u1)"""


def _score(col: str, name: str) -> str:
    q = [f"quantile_cont({col}, {k / 5}) q{k}" for k in range(6)]
    return f"""
e_{name} as (select {', '.join(q)}, count(*) n from u),
k_{name} as (select user_id, {col} v, row_number() over (order by {col}, user_id) rk from u),
s_{name} as (select user_id, case
  when q0 < q1 and q1 < q2 and q2 < q3 and q3 < q4 and q4 < q5 then
    1 + (v > q1)::int + (v > q2)::int + (v > q3)::int + (v > q4)::int
  when n = 1 then 3
  else greatest(1, ((rk - 1) * 5 + n - 2) // (n - 1)) end bin from k_{name}, e_{name})"""


SCORES = ",".join(
    [USERS.strip(), _score("recency", "r"), _score("frequency", "f"), _score("monetary", "m")]
) + """,
us as (select u.*, cast(6 - s_r.bin as int) r_score, cast(s_f.bin as int) f_score, cast(s_m.bin as int) m_score
  from u join s_r using (user_id) join s_f using (user_id) join s_m using (user_id)),
users as (select *, r_score + f_score + m_score rfm_score,
  r_score || '-' || f_score || '-' || m_score rfm_raw,
  case when account_age_days < 30 then 'New'
    when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions'
    when r_score >= 3 and f_score >= 3 and m_score >= 3 then 'Loyalists'
    when r_score >= 3 then 'Promising' when f_score >= 3 then 'At Risk'
    when m_score >= 3 then 'About to Sleep' else 'Hibernating' end segment from us)"""

LIFE = f"""
life as (select user_id, (mx - first_us) // {DAY} tenure, first_us,
  case when max_gap > 90 and (mx - last_us) // {DAY} < 30 then 'Reactivated'
    when (mx - first_us) // {DAY} < 30 then 'New'
    when frequency = 1 and (mx - first_us) // {DAY} < 60 then 'New'
    when first_us >= mx - 30 * {DAY} and frequency <= 3 then 'New'
    when (mx - first_us) // {DAY} < 120 then 'Active' else 'Established' end lifecycle from u0, b)"""

SCORED = SCORES + "," + LIFE.strip() + """,
p0 as (select users.*, recency / (select max(recency) from users) p from users),
p1 as (select *, monetary + monetary_velocity * 365 * (1 - p) ltv0,
  least(monetary_velocity * 90 * p, greatest(monetary, 1)) rar0 from p0),
p2 as (select *, p * rar0 prio from p1),
p3 as (select *, (rank() over (order by prio) + (count(*) over (partition by prio) - 1) / 2.0)
  / count(*) over () pct from p2),
cap as (select quantile_cont(rar0, 0.99) cr, quantile_cont(ltv0, 0.99) cl from p1),
scored as (select p3.*, p churn_probability, life.lifecycle, life.tenure,
  round(pct * 100, 1) priority_score,
  round(least(greatest(rar0, 0), cr), 2) revenue_at_risk,
  round(least(greatest(ltv0, 0), cl), 2) predicted_ltv,
  round(150 + monetary / greatest(frequency, 1) * case when p > 0.8 then 0.25 when p > 0.5 then 0.15
    when p > 0.2 then 0.08 else 0.03 end, 2) intervention_cost,
  least(greatest(ltv0, 0), cl) > monetary + round(150 + monetary / greatest(frequency, 1) *
    case when p > 0.8 then 0.25 when p > 0.5 then 0.15 when p > 0.2 then 0.08 else 0.03 end, 2) is_profitable
  from p3 join life using (user_id), cap)"""

SEGMENTS = SCORED + """,
sg0 as (select segment, count(*) "count", avg(monetary) avg_monetary, avg(frequency) avg_frequency,
  avg(monetary_velocity) avg_velocity, sum(revenue_at_risk) total_revenue_at_risk,
  case when sum(monetary) > 0 then sum(p * monetary) / sum(monetary) else avg(p) end ch from scored group by segment),
sg1 as (select *, round(avg_monetary + avg_velocity * 365 * (1 - ch), 2) est_ltv,
  round(5 + avg_monetary / greatest(avg_frequency, 1) * case when ch > 0.8 then 0.2 when ch > 0.5 then 0.1
    when ch > 0.2 then 0.05 else 0.02 end, 2) intervention_cost, round(ch, 4) avg_churn from sg0),
seg as (select *, est_ltv > avg_monetary + intervention_cost is_profitable,
  case when avg_churn >= 0.4 then 'CRITICAL' when avg_churn >= 0.2 then 'WARNING' else 'STABLE' end status from sg1)"""


def sql(lists: str, body: str, source: str = TX) -> str:
    head = ", ".join(x.strip() for x in (source, lists) if x.strip())
    return f"with {head} {body}"

# worth of every coalition (bit 1 recency, 2 frequency, 4 monetary) under a tree of five leaves, by its definition
_RULE_TREE = """,
cuts as (select quantile_cont(recency, 0.5) a, quantile_cont(recency, 0.75) c, quantile_cont(frequency, 0.5) b,
  quantile_cont(monetary, 0.5) m from u),
parts as (select u.*, recency <= a lo, recency > a and recency <= c mid, recency > c hi, frequency <= b few, monetary <= m small from u, cuts),
sums as (select count(*) n, count_if(lo) nl, count_if(mid) nm, count_if(hi) nh, count_if(lo and few) nf, count_if(lo and not few) ng,
  count_if(lo and not few and small) ns, count_if(lo and not few and not small) nb,
  avg(avg_basket_value) filter (lo and few) v1, avg(avg_basket_value) filter (lo and not few and small) v2,
  avg(avg_basket_value) filter (lo and not few and not small) v3, avg(avg_basket_value) filter (mid) v4,
  avg(avg_basket_value) filter (hi) v5 from parts),
worths as (select user_id, """ + ", ".join(
    "v1 * {l} * {f} + v2 * {l} * {g} * {s} + v3 * {l} * {g} * {b} + v4 * {m} + v5 * {h}".format(
        l="lo::int" if k & 1 else "nl / n", m="mid::int" if k & 1 else "nm / n", h="hi::int" if k & 1 else "nh / n",
        f="few::int" if k & 2 else "nf / nl", g="(not few)::int" if k & 2 else "ng / nl",
        s="small::int" if k & 4 else "ns / ng", b="(not small)::int" if k & 4 else "nb / ng") + f" w{k}" for k in range(8)
) + " from parts, sums)"


ORACLES: dict[str, str] = {
    "rfm_base": sql(USERS, """select user_id, frequency, round(monetary, 4) monetary,
        round(avg_basket_value, 4) avg_basket_value, round(monetary_std, 4) monetary_std,
        round(max_spend, 4) max_spend, round(min_spend, 4) min_spend, recency, account_age_days from u"""),
    "account_age": sql(USERS, "select user_id, account_age_days, round(monetary_velocity, 4) monetary_velocity from u"),
    "ipi": sql(USERS, """select user_id, round(ipi_median, 4) ipi_median, round(ipi_std, 4) ipi_std,
        round(ipi_consistency, 4) ipi_consistency, round(recency_deviation, 4) recency_deviation from u"""),
    "ipi_events": sql(USERS, """select user_id, round(ipi_median, 4) ipi_median, round(ipi_std, 4) ipi_std,
        round(ipi_consistency, 4) ipi_consistency, round(recency_deviation, 4) recency_deviation from u""", EV),
    "first_attributes": sql("", """select user_id,
        (min({'t': ts, 'v': description})).v description, (min({'t': ts, 'v': status})).v status from tx group by user_id"""),
    "custom_numeric_means": """select cast(o_custkey as varchar) user_id, round(avg(l_quantity), 4) "Quantity",
        round(avg(l_extendedprice / l_quantity), 4) "UnitPrice"
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1""",
    "trend_features": sql(f"b as (select min(epoch_us(ts)) mn, max(epoch_us(ts)) mx from tx)", f"""select user_id,
        round((count(*) filter (epoch_us(ts) >= mn + (mx + {DAY} - mn) / 2.0) + 1)
          / (count(*) filter (epoch_us(ts) < mn + (mx + {DAY} - mn) / 2.0) + 1), 6) frequency_trend,
        round((coalesce(sum(amount) filter (epoch_us(ts) >= mn + (mx + {DAY} - mn) / 2.0), 0) + 1)
          / (coalesce(sum(amount) filter (epoch_us(ts) < mn + (mx + {DAY} - mn) / 2.0), 0) + 1), 6) monetary_trend
        from tx, b group by user_id"""),
    "failure_rate": sql("", "select user_id, round(avg(is_failure), 6) failure_rate from tx group by user_id", EV),
    "recent_spend_ratio": sql(f"""b as (select min(epoch_us(ts)) mn, max(epoch_us(ts)) mx from tx),
        c as (select mn + greatest(cast(floor(((mx - mn) // {DAY}) * 0.7) as bigint), 1) * {DAY} cut from b)""",
        """select user_id, round(coalesce(sum(amount) filter (epoch_us(ts) >= cut), 0) / (sum(amount) + 1e-9), 6)
        recent_spend_ratio from tx, c group by user_id"""),
    "ratio_features": sql(USERS, """select user_id, round(recency / (ipi_median + 1e-9), 3) ipi_ratio,
        round(recency * ipi_median, 3) recency_x_ipi, round(monetary * frequency, 3) monetary_x_frequency,
        round(monetary / (frequency + 1e-9), 3) monetary_per_txn, round(frequency / account_age_days, 3) frequency_velocity,
        round(monetary / (max_spend + 1e-9), 3) monetary_ratio, round(ln(1 + greatest(monetary, 0)), 3) log_monetary,
        round(ln(1 + greatest(frequency, 0)), 3) log_frequency, round(ln(1 + greatest(avg_basket_value, 0)), 3) log_avg_basket_value,
        round(ln(1 + greatest(monetary_velocity, 0)), 3) log_monetary_velocity,
        round(ln(1 + greatest(max_spend, 0)), 3) log_max_spend from u"""),
    "total_users": sql("", "select count(distinct user_id) total_users from tx"),
    "value_counts_segment": sql(SCORES, """select segment, count(*) users,
        round(count(*) / (select count(*) from users), 6) "share" from users group by segment"""),
    "value_counts_lifecycle": sql(SCORED, """select lifecycle, count(*) users,
        round(count(*) / (select count(*) from scored), 6) "share" from scored group by lifecycle"""),
    "counterparty_diversity": """select cast(user_id as varchar) user_id, count(distinct event_id % 37) counterparties
        from events group by 1""",
    "max_gap": sql(USERS, "select user_id, cast(max_gap as bigint) max_gap from u"),
    "quintile_scores": sql(SCORES, "select user_id, r_score, f_score, m_score from users"),
    "quintile_scores_tied": sql(SCORES, "select user_id, r_score, f_score, m_score from users", EV),
    "rfm_score": sql(SCORES, "select user_id, rfm_score, rfm_raw from users"),
    "segment": sql(SCORES, "select user_id, segment from users"),
    "segment_legacy": sql(SCORES, """select user_id, case when rfm_score >= 13 and r_score >= 4 then 'Champions'
        when rfm_score >= 10 and r_score >= 3 then 'Loyalists' when r_score <= 1 and rfm_score <= 5 then 'Hibernating'
        when r_score <= 2 and rfm_score >= 8 then 'At Risk' when rfm_score >= 7 then 'Promising'
        when rfm_score >= 4 then 'Needs Attention' else 'Hibernating' end segment from users"""),
    "global_rank": sql("", """select user_id, row_number() over (order by m, user_id) "rank"
        from (select user_id, sum(amount) m from tx group by user_id)"""),
    "pct_rank_avg": sql("", """select user_id, round((rank() over (order by f) + (count(*) over (partition by f) - 1) / 2.0)
        / count(*) over (), 6) pct from (select user_id, count(*) f from tx group by user_id)"""),
    "pct_rank_days": sql(USERS, """select user_id, round((rank() over (order by recency)
        + (count(*) over (partition by recency) - 1) / 2.0) / count(*) over (), 6) pct from u"""),
    "quantile_clip": sql(USERS, """select user_id,
        round(least(greatest(monetary, 0), (select quantile_cont(monetary, 0.99) from u)), 4) monetary from u"""),
    "join_left_attrs": sql(SCORES, """select user_id, segment, description, status from users left join
        (select user_id, (min({'t': ts, 'v': description})).v description, (min({'t': ts, 'v': status})).v status
         from tx group by user_id) using (user_id)"""),
    "join_inner_segment": sql(SCORES, """select segment, description, count(*) n from tx join users using (user_id)
        group by segment, description"""),
    "join_semi_top": """select l_partkey, count(*) n, round(sum(l_quantity), 4) qty from lineitem where l_partkey in
        (select l_partkey from lineitem group by 1 order by count(*) desc, l_partkey limit 8) group by 1""",
    "join_anti_future": sql("c as (select max(ts) - interval 120 day cut from tx)", """select distinct user_id from tx, c
        where ts <= cut and user_id not in (select user_id from tx, c where ts > cut)"""),
    "join_scalar": sql("m as (select user_id, sum(amount) v from tx group by user_id)",
        "select user_id, round(v - (select avg(v) from m), 3) above_mean from m"),
    "join_label_alignment": sql("", "select user_id, cast(max(is_failure) as int) is_failure from tx group by user_id", EV),
    "heuristic_churn": sql(SCORED, "select user_id, round(p, 6) churn_probability from scored"),
    "velocity_guard": sql(USERS, "select user_id, round(monetary / 365, 4) monetary_velocity from u"),
    "predicted_ltv": sql(SCORED, "select user_id, round(ltv0, 2) predicted_ltv from p1"),
    "revenue_at_risk": sql(SCORED, """select user_id, round(rar0, 2) rar_90,
        round(least(monetary_velocity * 365 * p, greatest(monetary, 1)), 2) rar_365 from p1"""),
    "priority_score": sql(SCORED, "select user_id, priority_score from scored"),
    "clip_round": sql(SCORED, "select user_id, revenue_at_risk, predicted_ltv from scored"),
    "intervention_cost": sql(SCORED, "select user_id, round(intervention_cost, 1) intervention_cost from scored"),
    "is_profitable": sql(SCORED, "select user_id, cast(is_profitable as int) is_profitable from scored"),
    "rar_summary": sql(SCORED, """select round(sum(revenue_at_risk), 2) total,
        round(coalesce(sum(revenue_at_risk) filter (p >= 0.3), 0), 2) critical from scored"""),
    "rar_by_segment": sql(SCORED, """select segment, round(sum(revenue_at_risk), 2) revenue_at_risk, count(*) users,
        round(avg(p), 4) churn_probability,
        round(case when sum(monetary_velocity) = 0 then avg(p) else sum(p * monetary_velocity) / sum(monetary_velocity) end, 4) avg_churn,
        count(*) filter (p >= 0.3) high_risk_count from scored group by segment"""),
    "potential_recovery": sql(SCORED, """select round(case when max(p) >= 0.5 then
        sum(revenue_at_risk) filter (p >= 0.5 * 0.7) * least(0.4, greatest(0.1, 0.8 * 0.4)) else 0 end, 2) "value",
        cast(32.0 as double) efficiency_pct, count(*) filter (p >= 0.5) critical_count,
        count(*) filter (p >= 0.5 * 0.7) addressable_count, 0::int is_adaptive from scored"""),
    "potential_recovery_adaptive": sql(SCORED, """select
        round(sum(revenue_at_risk) filter (p * 0.4 >= (select quantile_cont(p * 0.4, 0.75) from scored)) * 0.32, 2) "value",
        cast(32.0 as double) efficiency_pct, count(*) filter (p * 0.4 >= 0.5) critical_count,
        count(*) filter (p * 0.4 >= (select quantile_cont(p * 0.4, 0.75) from scored)) addressable_count,
        1::int is_adaptive from scored"""),
    "kpis": sql(SCORED, """select count(*) total_users, round(sum(p * monetary) / greatest(sum(monetary), 1), 5) avg_churn_risk,
        round(avg(p), 5) baseline_churn_rate, round(avg(coalesce(predicted_ltv, monetary)), 2) mean_ltv from scored"""),
    "risk_counts": sql(SCORED + ", q as (select quantile_cont(p, 0.75) a, quantile_cont(p, 0.9) z from scored)",
        """select count(*) filter (p >= a) total_high_risk_users,
        count(*) filter (p >= a and lifecycle = 'New') onboarding_risk_users,
        count(*) filter (p >= z) critical_threshold_users from scored, q"""),
    "risk_tiers": sql(SCORED + """, a as (select avg(p) m from scored), t as (select
        case when m > 0 and m <= 0.35 then least(m * 1.5, 0.9) else 0.5 end hi,
        case when m > 0 and m <= 0.35 then least(m * 2.0, 0.95) else 0.7 end cr from a)""",
        """select user_id, round(hi, 6) high_mark, round(cr, 6) critical_mark,
        case when p >= cr then 'Critical' when p >= hi then 'High' else 'Normal' end risk_tier from scored, t"""),
    "segment_churn": sql(SEGMENTS, """select segment, "count", round(avg_monetary, 2) avg_monetary,
        round(avg_frequency, 4) avg_frequency, round(avg_velocity, 4) avg_velocity,
        round(total_revenue_at_risk, 2) total_revenue_at_risk, round(est_ltv, 1) est_ltv,
        round(intervention_cost, 1) intervention_cost, avg_churn, cast(is_profitable as int) is_profitable, status from seg"""),
    "churn_forecast": sql(SCORED + """, q as (select quantile_cont(p, 0.75) a from scored),
        risky as (select user_id, row_number() over (order by md5(user_id || ':42')) rk, count(*) over () n from scored, q where p >= a),
        ad as (select user_id from risky where rk <= cast(floor(n * 0.6) as bigint)),
        x as (select scored.*, case when ad.user_id is null then p else p * 0.6 end po from scored left join ad using (user_id)),
        f as (select step, sum((1 - least(greatest(pow(1 - p, step / 3.0), 0), 1)) * monetary) / greatest(sum(monetary), 1) * 100 bl,
          sum((1 - least(greatest(pow(1 - po, step / 3.0), 0), 1)) * monetary) / greatest(sum(monetary), 1) * 100 op
          from x, (select unnest([1,2,3,4,5,6])::int step) group by step)""",
        """select step, ['Sep','Oct','Nov','Dec','Jan','Feb'][step] "month", round(bl, 1) baseline, round(op, 1) risk,
        round(greatest(bl - op, 0), 1) saved from f"""),
    "portfolio_audit": sql("", """select round(sum(amount), 2) monitored, cast(0.005 as double) margin,
        round(sum(amount) * 0.005, 2) addressable_margin, cast(0.32 as double) efficiency from tx"""),
    "mean_ltv": sql(SCORED, "select round(avg(coalesce(predicted_ltv, monetary)), 2) mean_ltv from scored"),
    "warning_cohort": sql(SCORED, """select user_id,
        cast(p * 0.4 >= (select quantile_cont(p * 0.4, 0.8) from scored) as int) is_warning from scored"""),
    "lifecycle": sql(USERS + "," + LIFE, """select user_id, lifecycle,
        strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S') first_seen, tenure from life"""),
    "lifecycle_events": sql(USERS + "," + LIFE, """select user_id, lifecycle,
        strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S') first_seen, tenure from life""", EV),
}

COHORTS = """f as (select user_id, min(date_trunc('month', ts)) c from tx group by user_id),
  z as (select c, count(*) size from f group by c),
  a as (select c, datediff('month', c, date_trunc('month', ts)) period, count(distinct tx.user_id) active
    from tx join f using (user_id) group by 1, 2),
  ch as (select strftime(c, '%Y-%m') cohort, cast(period as int) period, active, size, round(active / size * 100, 1) retention
    from a join z using (c))"""
ORACLES["cohort_retention"] = sql(COHORTS, "select cohort, period, active, size, retention from ch")
_CELLS = ", ".join(
    f"coalesce(max(retention) filter (period = {i}), 0.0) m{i:02d}" for i in range(12)
)
ORACLES["cohort_matrix"] = sql(COHORTS, f"select cohort, max(size) size, {_CELLS} from ch group by cohort")
_LIST = ", ".join(f"({i})" for i in range(12))
ORACLES["survival_floor"] = sql(COHORTS, f"""select round(least(greatest(avg(case when r > 1 then r / 100 else r end), 0.1), 0.9), 5)
    survival_floor from (select coalesce(ch.retention, 0.0) r from (select distinct cohort from ch) co
    cross join (values {_LIST}) k(i) left join ch on ch.cohort = co.cohort and ch.period = k.i)""")

TOP8 = "top8 as (select description product from tx group by 1 order by count(*) desc, product limit 8)"
ORACLES["product_mix_segment"] = sql(SCORED + ", " + TOP8, """select segment, description product, count(*) "count",
    row_number() over (partition by segment order by count(*) desc, description) "rank"
    from tx join scored using (user_id) where description in (select product from top8)
    group by segment, description qualify "rank" <= 5""")
ORACLES["product_risk"] = sql(SCORED + ", " + TOP8 + """, pu as (select distinct description product, user_id from tx
    where description in (select product from top8)),
    pr as (select product, count(*) "count", (avg(p) - (select avg(p) from scored))
      / greatest((select avg(p) from scored), 0.01) * 100 d from pu left join scored using (user_id) group by product)""",
    """select product, "count", round(d, 4) risk_diff,
    case when d > 12 then 'High' when d < -12 then 'Low' else 'Neutral' end risk_level,
    case when d > 12 then 'High churn correlation (' || printf('%+.1f', d) || '% vs avg). Likely ''One-off'' gift buyers.'
      when d < -40 then 'Strategic Anchor (' || printf('%.1f', abs(d)) || '% lower risk). Critical for long-term retention.'
      when d < -12 then 'Healthy Retention Signal (' || printf('%.1f', abs(d)) || '% lower risk). Core recurring product.'
      else 'Neutral behavioral footprint.' end risk_insight from pr""")
ORACLES["interventions"] = sql(SEGMENTS, """select segment,
    case when avg_churn > 0.6 then 'Critical churn at ' || printf('%.0f', avg_churn * 100) || '% driven by Recency'
      when avg_churn > 0.3 then 'Elevated risk (' || printf('%.0f', avg_churn * 100) || '%) with declining recency'
      else 'Stable (' || printf('%.0f', avg_churn * 100) || '%) but growth opportunity' end problem,
    case when avg_churn > 0.6 then 'Emergency ₹' || least(500, cast(floor(avg_monetary * 0.1) as bigint)) || ' cashback + priority support'
      when avg_churn > 0.3 then 'Personalized ₹' || least(200, cast(floor(avg_monetary * 0.05) as bigint)) || ' incentive + re-engagement sequence'
      else 'Loyalty tier upgrade + cross-sell premium products' end "action", 'Recency' driver,
    case when avg_churn > 0.6 then least(500, cast(floor(avg_monetary * 0.1) as bigint))
      when avg_churn > 0.3 then least(200, cast(floor(avg_monetary * 0.05) as bigint)) else 75 end est_cost_per_user,
    cast(case when avg_churn > 0.6 then 20 when avg_churn > 0.3 then 12 else 5 end as int) expected_churn_reduction from seg""")
ORACLES["intervention_roi"] = sql(SEGMENTS, """select segment, round(avg_churn * round(est_ltv) * "count", 0) exposure,
    case when is_profitable then round(least(8.5, greatest(1.2, round(est_ltv)
      / case when round(intervention_cost) = 0 then 1 else round(intervention_cost) end * (0.8 * 0.08))), 1) end roi_multiplier,
    case when avg_churn > 0.4 then 'Critical churn at ' || printf('%.1f', avg_churn * 100) || '%'
      when avg_churn > 0.2 then 'Elevated risk at ' || printf('%.1f', avg_churn * 100) || '%'
      when segment = 'Champions' then 'Stable (' || printf('%.1f', avg_churn * 100) || '%) — protect & grow'
      when segment = 'Loyalists' then 'Stable (' || printf('%.1f', avg_churn * 100) || '%) but growth opportunity'
      when segment = 'Promising' then 'Rising (' || printf('%.1f', avg_churn * 100) || '%) — needs nurture'
      when segment = 'At Risk' then 'High churn risk (' || printf('%.1f', avg_churn * 100) || '%) — urgent'
      when segment = 'Hibernating' then 'Dormant (' || printf('%.1f', avg_churn * 100) || '%) — re-engage needed'
      when segment = 'Needs Attention' then 'Irregular (' || printf('%.1f', avg_churn * 100) || '%) — friction present'
      when segment = 'New' then 'Early (' || printf('%.1f', avg_churn * 100) || '%) — onboarding phase'
      else 'Stable performance at ' || printf('%.1f', avg_churn * 100) || '%' end problem,
    case when not is_profitable then 'Minimize Loss / Debt Recovery'
      when segment = 'Champions' then 'VIP concierge + exclusive reward tier'
      when segment = 'Loyalists' then 'Loyalty tier upgrade + cross-sell premium products'
      when segment = 'Promising' then 'Onboarding nudge + early loyalty reward'
      when segment = 'At Risk' then 'Urgent win-back offer + personalised outreach'
      when segment = 'Hibernating' then 'High-value re-engagement incentive campaign'
      when segment = 'Needs Attention' then 'Friction audit + targeted UX improvement'
      when segment = 'New' then 'Second-purchase incentive + guided onboarding'
      else 'Targeted retention campaign' end "action" from seg""")
ORACLES["data_health"] = sql(f"""h as (select (max(epoch_us(ts)) - min(epoch_us(ts))) // {DAY} as dd,
    (avg((user_id is null)::int) + avg((ts is null)::int) + avg((amount is null)::int) + avg((description is null)::int)
     + avg((status is null)::int)) / 5 nulls, count(distinct user_id) users, (stddev_samp(amount) > 0)::int * 100 vary from tx),
    s as (select *, (least(100, dd / 3.65) + greatest(0, 100 - nulls * 500) + least(100, users / 1000 * 100) + vary) / 4 sc from h)""",
    """select round(sc, 1) score, case when sc > 85 then 'Excellent' when sc > 65 then 'Good' when sc > 40 then 'Fair' else 'Poor' end status,
    users user_volume, round(nulls * 100, 2) null_pct, dd days_of_history from s""")
ORACLES["user_sample"] = sql(SCORED, """select user_id, lifecycle, round(p, 6) churn_probability from scored
    order by case when lifecycle = 'New' then 0 else 1 end, case when lifecycle <> 'New' then p end desc nulls last, user_id limit 1000""")
ORACLES["top_users_to_save"] = sql(SCORED + """, x as (select user_id, p * (coalesce(predicted_ltv, monetary)
    / greatest((select max(coalesce(predicted_ltv, monetary)) from scored), 1)) pr from scored)""",
    """select user_id, round(pr, 4) priority, round(least(100, pr / greatest((select max(pr) from x), 1) * 100), 4) priority_pct
    from x order by pr desc, user_id limit 50""")
ORACLES["onboarding_list"] = sql(SCORED, """select user_id, round(p, 6) churn_probability from scored
    where lifecycle = 'New' and contains(lower(user_id), '1') order by p desc, user_id limit 10""")
ORACLES["segment_priority"] = sql(SEGMENTS + """, q as (select quantile_cont(p, 0.75) a from scored),
    o as (select count(*) filter (p >= a and lifecycle = 'New') > count(*) * 0.15 ob from scored, q)""",
    """select case when ob then 'Onboarding' else segment end priority_segment, cast(ob as int) is_onboarding,
    segment worst_segment, avg_churn from seg, o order by avg_churn desc, segment limit 1""")
ORACLES["personas"] = sql(SCORES, """select user_id, case segment when 'Champions' then 'The Loyal Giant'
    when 'Loyalists' then 'The Steady Pillar' when 'Promising' then 'The Rising Star' when 'At Risk' then 'The Fading Star'
    when 'Hibernating' then 'The Lost Soul' when 'Needs Attention' then 'The Drifting User' when 'New' then 'Onboarding'
    else segment end persona from users""")
ORACLES["roi_status"] = sql(SCORED, """select user_id,
    case when is_profitable then 'Profitable' else 'At Risk / Non-Profitable' end roi_status,
    case when coalesce(intervention_cost, 0) = 0 then 15 else round(intervention_cost, 1) end roi_cost from scored""")

# ---- ingestion -----------------------------------------------------------------------------------

RETAIL = """raw as (select case when o_orderkey % 50 = 0 then 'C' || o_orderkey else cast(o_orderkey as varchar) end invoice,
  l_partkey, p_type, l_quantity qty, l_extendedprice / l_quantity price, o_orderdate ts, cast(o_custkey as varchar) user_id
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
BANK = f"""last as (select max(o_orderdate) t from orders),
  pu as (select o_custkey, count(*) n, min(o_orderdate) f, max(o_orderdate) l from orders group by 1),
  bank as (select cast(c_custkey as varchar) user_id, c_acctbal bal, n, cast(datediff('day', f, t) // 365 as double) ten,
    abs(c_acctbal) * 12 salary, cast(datediff('day', l, t) > 120 as int) exited
    from customer join pu on c_custkey = o_custkey, last),
  tb as (select *, case when (select max(ten) from bank) <= 25 then ten * 12 else ten end tm from bank)"""
DIRTY = """d as (select o_orderkey, case when o_orderkey % 11 = 0 then '  ' when o_orderkey % 13 = 0 then 'nan'
    else ' ' || o_custkey || ' ' end user_id,
  case when o_orderkey % 7 = 0 then 0 else o_totalprice end monetary,
  case when o_orderkey % 3 in (0, 1) then 1 else 0 end label, o_orderpriority product, o_orderdate ts from orders)"""
TAX = """raw as (select cast(o_custkey as varchar) user_id, l_extendedprice amount, l_extendedprice * l_tax tds,
  l_returnflag head, l_returnflag || l_linestatus sec, quarter(o_orderdate) qt from lineitem join orders on l_orderkey = o_orderkey),
  dv as (select user_id, count(distinct head) income_diversity, count(distinct sec) section_count,
    count(distinct qt) quarters_active from raw group by user_id)"""

ORACLES.update({
    "read_parquet_tx": """select user_id, count(*) n, round(sum(a), 2) total from (select cast(o_custkey as varchar) user_id,
        o_totalprice a from orders union all select cast(user_id as varchar), value from events) group by 1""",
    "read_csv_any": "select o_orderpriority, count(*) n, round(sum(o_totalprice), 1) total from orders group by 1",
    "write_users_csv": sql(SCORES, "select user_id, segment, frequency, round(monetary, 2) monetary from users"),
    "read_csv_folder": "select o_orderpriority || ' é' priority, count(*) n, round(sum(o_totalprice), 1) total from orders group by 1",
    "append_dedupe": sql("", """select user_id, count(*) n, round(sum(a), 2) total from
        (select distinct invoice, user_id, ts, qty * price a, l_partkey from raw where invoice not like 'C%' and user_id <> '0') group by 1""", RETAIL),
    "union_dedupe": sql("", """select user_id, count(*) n, round(sum(a), 2) total from
        (select distinct invoice, user_id, ts, qty * price a, l_partkey from raw where invoice not like 'C%' and user_id <> '0') group by 1""", RETAIL),
    "detect_domain": """select 'retail' source, 'retail' "domain", count(*) "rows" from lineitem join orders on l_orderkey = o_orderkey
          join part on l_partkey = p_partkey
        union all select 'bank', 'bank_churn', count(*) from customer where c_custkey in (select o_custkey from orders)
        union all select 'upi', 'upi', count(*) from events
        union all select 'tax', 'tax', count(*) from lineitem join orders on l_orderkey = o_orderkey
        union all select 'orders', 'generic', count(*) from orders""",
    "map_columns": sql("", """select user_id, round(sum(qty), 3) quantity, strftime(max(ts), '%Y-%m-%d %H:%M:%S') "timestamp",
        round(max(price), 3) unit_price, min(p_type) description from raw group by user_id""", RETAIL),
    "coerce_numeric": sql("", "select o_orderkey, round(monetary, 2) monetary from d", DIRTY),
    "align_aliases": sql("", """select o_orderkey, round(monetary, 2) amount, round(monetary, 2) transaction_amount,
        user_id customer_id from d""", DIRTY),
    "standardise_churn_label": sql("", "select o_orderkey, label target_churn from d", DIRTY),
    "description_fallback": sql("", "select o_orderkey, product description from d", DIRTY),
    "clean_user_id": sql("", "select o_orderkey, trim(user_id) user_id from d where trim(user_id) not in ('', 'nan', '0')", DIRTY),
    "parse_timestamp": sql("", """select o_orderkey, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from
        (select o_orderkey, case when o_orderkey % 2 = 0 then date_trunc('minute', ts) else date_trunc('day', ts) end ts
         from d where o_orderkey % 17 <> 0)""", DIRTY),
    "date_layouts": """select unnest(['M/d/yyyy H:mm', 'dd/MM/yyyy', 'dd/MM/yyyy HH:mm', 'yyyy/MM/dd HH:mm', 'd-M-yyyy', 'dd MMM yyyy',
        'MMM d, yyyy h:mm a', 'yyyyMMdd', 'M/d/yy H:mm']) layout, n, n "read" from (select count(*) n from orders)""",
    "parse_epoch": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from events",
    "derive_amount": "select l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) amount from lineitem",
    "expand_summary": sql("""m as (select user_id, greatest(tm, 6) tenure_months, greatest(least(n, 10), 1) k,
          greatest(case when bal > 0 then bal else 0 end, 100) amt from tb),
        x as (select *, unnest(range(0, k)) t from m)""",
        """select user_id, strftime(date '2024-05-10' - to_days(cast(floor(greatest(cast(floor(tenure_months * 30) as int), 30)
          * (t + 1) / (k + 1)) as int)), '%Y-%m-%d') as "day", round(amt / k, 6) amount, round(tenure_months, 6) tenure_months from x""", BANK),
    "drop_cancellations": sql("", 'select invoice "Invoice", count(*) n from raw where invoice not like \'C%\' group by 1', RETAIL),
    "drop_non_positive": "select c_custkey, round(c_acctbal, 2) amount from customer where c_acctbal > 0",
    "drop_missing_keys": "select o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0",
    "sample_users": sql("""c as (select user_id, count(*) n, row_number() over (order by md5(user_id || ':42')) rk from tx group by 1),
        s as (select count(*) k from c)""",
        """select user_id, n from c, s where rk <= greatest(100, cast(floor(k * 0.25) as bigint))"""),
    "prepare_upi": """select cast(user_id as varchar) user_id, 'upi' "domain", count(*) n, round(sum(value), 2) total,
        cast(count(*) filter (event_type = 'error') as bigint) failures from events
        where value > 0 and user_id <> 0 group by 1""",
    "prepare_tax": sql("", """select user_id, count(*) n, max(income_diversity) income_diversity, max(section_count) section_count,
        min(quarters_active) quarters_active, round(sum(tds), 0) tds_amount, round(avg(tds / greatest(amount, 1)), 8) tds_rate
        from raw join dv using (user_id) where amount > 0 and user_id <> '0' group by user_id""", TAX),
    "prepare_bank_churn": sql("", """select user_id, cast(n as double) frequency, round(bal, 2) amount, round(tm, 2) tenure_months,
        round(tm * 30, 2) recency, exited target_churn, round(salary, 2) estimated_salary,
        strftime(timestamp '2024-05-10' - to_days(cast(tm * 30 as int)), '%Y-%m-%d') as "day" from tb where user_id <> '0'""", BANK),
    "prepare_retail": sql("", """select user_id, strftime(ts, '%Y-%m-%d') as "day", count(*) n, round(sum(qty * price), 2) total
        from raw where invoice not like 'C%' and qty * price > 0 and user_id <> '0' group by 1, 2""", RETAIL),
    "prepare_generic": """select cast(o_custkey as varchar) user_id, strftime(o_orderdate, '%Y-%m-%d') as "day", count(*) n,
        round(sum(o_totalprice), 2) total from orders where o_totalprice > 0 and o_custkey <> 0 group by 1, 2""",
    "prepare_auto": sql("", 'select \'tax\' "domain", count(*) n, round(sum(amount), 0) total from raw where amount > 0 and user_id <> \'0\'', TAX),
    "rfm_summary": sql(f"""r as (select max(epoch_us(timestamp '2024-05-10' - to_days(cast(tm * 30 as int)))) + {DAY} ref from tb where user_id <> '0')""",
        f"""select user_id, cast(1 as bigint) frequency, round(bal, 3) monetary,
        cast((ref - epoch_us(timestamp '2024-05-10' - to_days(cast(tm * 30 as int)))) // {DAY} as double) recency,
        round(tm * 30, 3) account_age_days, round(salary / 365, 3) monetary_velocity, cast(1 as double) ipi_consistency from tb, r where user_id <> '0'""", BANK),
})

# ---- labels, evaluation, drift -------------------------------------------------------------------

CUT = f"""all_tx as (select cast(o_custkey as varchar) user_id, o_orderdate ts, o_totalprice amount,
  o_orderpriority description, o_orderstatus status from orders),
  w as (select min(epoch_us(ts)) mn0, max(epoch_us(ts)) mx0,
    least(120, greatest(45, cast(floor(((max(epoch_us(ts)) - min(epoch_us(ts))) // {DAY}) * 0.3) as bigint))) dy from all_tx),
  cu as (select *, mx0 - dy * {DAY} cut from w),
  tx as (select all_tx.* from all_tx, cu where epoch_us(ts) <= cut),
  lab as (select user_id, case when user_id in (select user_id from all_tx, cu where epoch_us(ts) > cut) then 0 else 1 end churned
    from (select distinct user_id from tx))"""
RATED = """rated as (select lab.user_id, recency / (select max(recency) from u) p, churned label from lab join u using (user_id))"""
KS = """hv as (select feature, v, sum(a) a, sum(b) b from samples group by 1, 2),
  cd as (select feature, abs(sum(a) over (partition by feature order by v) / sum(a) over (partition by feature)
    - sum(b) over (partition by feature order by v) / sum(b) over (partition by feature)) g,
    cast(sum(a) over (partition by feature) as bigint) na, cast(sum(b) over (partition by feature) as bigint) nb from hv),
  dd as (select feature, max(g) d, max(na) n_a, max(nb) n_b from cd group by 1),
  ks as (select *, d * sqrt(n_a * n_b / (n_a + n_b)) lam from dd),
  kp as (select feature, d, n_a, n_b, case when lam < 0.2 then 1.0 else least(greatest((select sum(case when k % 2 = 1 then 2.0 else -2.0 end
    * exp(-2.0 * k * k * lam * lam)) from range(1, 101) t(k)), 0), 1) end p from ks)"""


def _samples(cols: list[str], a: str, b: str) -> str:
    parts = [f"select '{c}' feature, cast({c} as double) v, 1 a, 0 b from {a} union all select '{c}', cast({c} as double), 0, 1 from {b}" for c in cols]
    return "samples as (" + " union all ".join(parts) + ")"


_FIVE = ["recency", "frequency", "monetary", "ipi_median", "account_age_days"]
_BASE = """bl as (select * from cents where frequency <= 9),
  blr as (select round(recency, 6) recency, frequency, round(monetary, 6) monetary, round(ipi_median, 6) ipi_median,
    account_age_days from bl)"""
_CENTS = ", cents as (select * replace (round(monetary, 2) as monetary) from users),"
_FLAGS = SCORES + _CENTS + _BASE + "," + _samples(_FIVE, "cents", "blr") + "," + KS

ORACLES.update({
    "temporal_labels": sql("", "select user_id, cast(churned as int) churned from lab", CUT),
    "temporal_training_set": sql(SCORES + f""",
        tr as (select user_id, (count(*) filter (epoch_us(ts) >= mn0 + (cut - mn0) / 2.0) + 1)
          / (count(*) filter (epoch_us(ts) < mn0 + (cut - mn0) / 2.0) + 1) frequency_trend,
          coalesce(sum(amount) filter (epoch_us(ts) >= mn0 + greatest(cast(floor(((cut - mn0) // {DAY}) * 0.7) as bigint), 1) * {DAY}), 0)
          / (sum(amount) + 1e-9) rsr from tx, cu group by user_id),
        rp as (select user_id, (rank() over (order by recency) + (count(*) over (partition by recency) - 1) / 2.0) / count(*) over () rp from u)""",
        """select user_id, frequency, round(monetary, 3) monetary, recency, round(ipi_median, 3) ipi_median, r_score, segment,
        round(frequency_trend, 3) frequency_trend, round(rsr, 3) recent_spend_ratio, round(rp, 3) recency_pct, cast(churned as int) churned
        from users join tr using (user_id) join rp using (user_id) join lab using (user_id)""", CUT),
    "feature_matrix": sql(SCORES + f""",
        tr as (select user_id, (count(*) filter (epoch_us(ts) >= mn0 + (cut - mn0) / 2.0) + 1)
          / (count(*) filter (epoch_us(ts) < mn0 + (cut - mn0) / 2.0) + 1) frequency_trend,
          coalesce(sum(amount) filter (epoch_us(ts) >= mn0 + greatest(cast(floor(((cut - mn0) // {DAY}) * 0.7) as bigint), 1) * {DAY}), 0)
          / (sum(amount) + 1e-9) rsr from tx, cu group by user_id)""",
        """select user_id, cast(frequency as double) x0, round(monetary, 3) x1, recency x2, round(ipi_median, 3) x3, round(frequency_trend, 3) x4,
        round(rsr, 3) x5, 0.0::double x6 from users join tr using (user_id) join lab using (user_id)""", CUT),
    "model_registry_scores": sql("", "select count(*) users, 0.0::double max_gap, 3 kept from lab", CUT),
    "score_invariants": sql("", """select unnest(['forest', 'boosted']) model, n users, n ids, 0 odd
        from (select count(distinct user_id) n from lab)""", CUT),
    "interaction_additivity": sql(USERS, "select user_id, 1 adds_up from u"),
    "shap_rule_tree": sql(USERS, _RULE_TREE + """ select user_id, round(
        (w1 - w0) / 3 + (w3 - w2) / 6 + (w5 - w4) / 6 + (w7 - w6) / 3, 4) phi_recency,
        round((w2 - w0) / 3 + (w3 - w1) / 6 + (w6 - w4) / 6 + (w7 - w5) / 3, 4) phi_frequency,
        round((w4 - w0) / 3 + (w5 - w1) / 6 + (w6 - w2) / 6 + (w7 - w3) / 3, 4) phi_monetary from worths"""),
    "shap_additivity": sql(USERS, "select user_id, 1 adds_up from u"),
    "silhouette_fixed": sql(SCORES + """,
        st as (select avg(recency) mr, stddev_samp(recency) sr, avg(frequency) mf, stddev_samp(frequency) sf, avg(monetary) mm, stddev_samp(monetary) sm from users),
        pt as (select user_id, r_score c, (recency - mr) / sr x, (frequency - mf) / sf y, (monetary - mm) / sm z from users, st),
        cl as (select c, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x * x + y * y + z * z) q from pt group by c),
        ds as (select p.user_id, p.c own, cl.c other, cl.n, (p.x * p.x + p.y * p.y + p.z * p.z) + cl.q / cl.n
            - 2 * (p.x * cl.sx + p.y * cl.sy + p.z * cl.sz) / cl.n dist from pt p, cl),
        ab as (select user_id, max(case when own = other then case when n > 1 then dist * n / (n - 1) else 0 end end) a,
            min(case when own <> other then dist end) b, max(case when own = other then n end) k from ds group by 1)""",
        "select round(avg(case when k = 1 then 0 when greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 5) silhouette from ab"),
    "label_churn_flag": sql("", "select user_id, exited churned from tb where user_id <> '0'", BANK),
    "labelled_training_set": sql(f"""bu as (select * from tb where user_id <> '0'),
        r as (select max(epoch_us(timestamp '2024-05-10' - to_days(cast(tm * 30 as int)))) + {DAY} ref from bu)""",
        f"""select user_id, round(bal, 2) monetary,
        cast((ref - epoch_us(timestamp '2024-05-10' - to_days(cast(tm * 30 as int)))) // {DAY} as double) recency,
        round(ln(1 + greatest(bal, 0)), 2) log_monetary, round(tm, 2) tenure_months, round(salary, 2) estimated_salary,
        exited churned from bu, r""", BANK),
    "split_60_20_20": sql("""z as (select user_id, row_number() over (partition by churned order by md5(user_id || ':42')) - 1 pos,
        count(*) over (partition by churned) n from lab)""",
        "select user_id, case when pos * 5 < n * 3 then 'train' when pos * 5 < n * 4 then 'cal' else 'test' end part from z", CUT),
    "threshold_opt": sql(USERS + "," + RATED + """,
        cand as (select distinct t from (select least(greatest(p, 0.01), 0.99) t from rated union all
          select unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]))),
        cf as (select t, count(*) filter (p >= t and label = 1) tp, count(*) filter (p >= t and label = 0) fp,
          count(*) filter (p < t and label = 1) fn, count(*) filter (p < t and label = 0) tn from cand, rated group by t),
        rt as (select *, tp / greatest(tp + fp, 1) pr, tp / greatest(tp + fn, 1) re, tn / greatest(tn + fp, 1) sp,
          abs(fp / greatest(tn + fp, 1) - fn / greatest(tp + fn, 1)) im from cf),
        sc as (select *, 2 * pr * re / greatest(pr + re, 1e-9) f1, (re + sp) / 2 ba from rt),
        ut as (select *, 0.45 * f1 + 0.45 * ba + 0.10 * (1 - im) s from sc)""",
        """select round(t, 6) threshold, tp, fp, fn, tn, round(re, 6) recall, round(sp, 6) specificity, round(f1, 6) f1,
        round(ba, 6) balanced_accuracy, round(s, 6) score from ut
        order by case when re >= 0.55 and sp >= 0.55 then 0 else 1 end, round(s, 12) desc, round(f1, 12) desc, round(ba, 12) desc, t limit 1""", CUT),
    "roc_auc": sql(USERS + "," + RATED + """,
        rk as (select label, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 r from rated),
        a as (select (sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0)
          / (count(*) filter (label = 1) * count(*) filter (label = 0)) v from rk)""",
        "select round(v, 6) roc_auc, round(2 * v - 1, 6) gini from a", CUT),
    "confusion_metrics": sql(USERS + "," + RATED + """,
        c as (select count(*) filter (p >= 0.2 and label = 1) tp, count(*) filter (p >= 0.2 and label = 0) fp,
          count(*) filter (p < 0.2 and label = 1) fn, count(*) filter (p < 0.2 and label = 0) tn from rated)""",
        """select tp, fp, fn, tn, round(tp / greatest(tp + fn, 1) * 100, 1) tp_rate, round(fn / greatest(tp + fn, 1) * 100, 1) fn_rate,
        round(tn / greatest(tn + fp, 1) * 100, 1) tn_rate, round(fp / greatest(tn + fp, 1) * 100, 1) fp_rate,
        round(tp / greatest(tp + fn, 1) * 100, 1) recall, round(tp / greatest(tp + fp, 1) * 100, 1) "precision",
        round(tn / greatest(tn + fp, 1) * 100, 1) specificity, round((tp + tn) / (tp + fp + fn + tn), 4) accuracy,
        round(2 * tp / (2 * tp + fp + fn), 4) f1 from c""", CUT),
    "ks_two_sample": sql(SCORES + """, ca as (select * from users where segment = 'Champions'),
        lo as (select * from users where segment = 'Loyalists'),""" + _samples(["recency", "frequency", "monetary", "ipi_median"], "ca", "lo") + "," + KS,
        "select feature, round(d, 6) d, n_a, n_b, round(p, 6) p from kp"),
    "temporal_drift": sql("""lt as (select all_tx.* from all_tx, cu where epoch_us(ts) > cut),""" + _samples(["amount"], "tx", "lt") + "," + KS,
        "select feature, round(d, 4) ks_statistic, round(p, 6) p_value, cast(p < 0.05 as int) drifted from kp", CUT),
    "drift_bonferroni": sql(_FLAGS, "select feature, round(d, 4) ks_statistic, round(p, 6) p_value, cast(p < 0.05 / 5 as int) drifted from kp"),
    "baseline_drift": sql(SCORES + _CENTS + """blr as (select recency, frequency, round(monetary, 6) monetary from cents), late as (select * from cents where recency > 60),"""
        + _samples(["recency", "frequency", "monetary"], "late", "blr") + "," + KS,
        "select feature, 'Baseline Drift' drift_type, round(d, 4) ks_statistic from kp"),
    "sketch_drift": sql(SCORES + _CENTS + """blr as (select recency, frequency, monetary from cents), late as (select * from cents where recency > 60),"""
        + _samples(["recency", "frequency", "monetary"], "late", "blr") + "," + KS,
        "select feature, 1 in_bound, round(d, 4) ks_exact, (p < 0.05 / 3)::int drifted from kp"),
    "drift_summary": sql(_FLAGS + """, fl as (select *, p < 0.05 / 5 drifted from kp),
        ag as (select count(*) total_features, count(*) filter (drifted) drifted_count, median(p) mp,
          round(count(*) filter (drifted) / count(*) * 100, 1) pc from fl),
        st as (select *, case when pc >= 50 and mp < 0.01 then 'HIGH DRIFT' when pc >= 25 or mp < 0.05 then 'LOW DRIFT' else 'STABLE' end status from ag)""",
        """select total_features, drifted_count, pc drifted_pct, status,
        case when status = 'HIGH DRIFT' then 'Drift Detected' else 'Stable' end data_drift_status, round(mp, 6) avg_p_value,
        case status """ + " ".join(f"when '{k}' then printf('{v}', drifted_count, total_features, printf('%.1f', pc))" for k, v in DRIFT_REASONS.items()) + """ end severity_reason,
        case status """ + " ".join(f"when '{k}' then '{' '.join(v)}'" for k, v in DRIFT_ACTIONS.items()) + """ end actions,
        (select list_aggregate(list_transform(string_split(replace(feature, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ')
          from fl where drifted order by round(d, 4) desc, feature limit 1) top_feature from st"""),
    "drift_baseline_save": sql(SCORES + """, lg as (select 'recency' feature, recency v from users union all select 'monetary', round(monetary, 6) from users)""",
        "select feature, count(*) n, round(avg(v), 2) mean, round(stddev_pop(v), 2) std from lg group by 1"),
})

_DRIVER = {
    "recency": "Recency (Days Since Last Order)", "frequency": "Purchase Frequency (Order Count)",
    "monetary": "Spending Engagement (Wallet Share)", "monetary_velocity": "Daily Income Velocity",
    "ipi_median": "Purchase Cycle (Days)", "avg_basket_value": "Average Order Value (AOV)",
}
_SPREAD = " union all ".join(
    f"select '{c}' raw_feature, '{label}' feature, stddev_pop({c}) / max(abs({c})) v from cents" for c, label in _DRIVER.items()
)
ORACLES["driver_table"] = sql(SCORES + _CENTS + f"sp as ({_SPREAD}), im as (select *, v / sum(v) over () i from sp)",
    """select raw_feature, feature, round(i, 5) importance, 'unknown' direction,
    case when i > 0.2 then 'Critical' when i > 0.1 then 'High' when i > 0.05 then 'Medium' else 'Low' end impact from im""")
#: Columns that models of the orders are fitted on.
_FITTED = [
    "account_age_days", "avg_basket_value", "f_score", "frequency", "frequency_trend", "frequency_velocity",
    "ipi_consistency", "ipi_median", "ipi_ratio", "ipi_std", "log_avg_basket_value", "log_frequency",
    "log_max_spend", "log_monetary", "log_monetary_velocity", "m_score", "max_spend", "min_spend", "monetary",
    "monetary_per_txn", "monetary_ratio", "monetary_std", "monetary_trend", "monetary_velocity",
    "monetary_x_frequency", "r_score", "recency", "recency_deviation", "recency_pct", "recency_x_ipi",
    "recent_spend_ratio",
]
ORACLES["model_hash"] = f"""select sha256('{",".join(sorted(_FITTED))}') schema_hash from (select count(*) n from orders) where n > 0"""

# ---- what-if, experiments, hypotheses ------------------------------------------------------------

_SCEN = ", ".join(
    f"('{n}', null, '{f}', {d}, {c})" for n, f, d, c in [
        ("cashback", "monetary", 20.0, 200.0), ("push", "frequency", 15.0, 50.0), ("discount", "monetary", 25.0, 150.0),
        ("loyalty", "frequency", 30.0, 100.0), ("email", "recency", -30.0, 500.0)]
) + ", ('strat_retail_winback', 'At Risk', 'monetary', 20.0, 150.0), ('strat_retail_reengage', 'Hibernating', 'frequency', 15.0, 45.0)"
GRID = SEGMENTS + f""",
sc0(scenario, sg, feature, delta_pct, cost_per_user) as (values {_SCEN}),
mxr as (select max(recency) m from u),
gr as (select scenario, segment, feature, cast(delta_pct as double) delta_pct, cast(cost_per_user as double) cost_per_user, p,
  least(greatest(recency * case when feature = 'recency' then 1 + delta_pct / 100 else 1 end / m, 0), 1) pn, monetary_velocity mv
  from scored join sc0 on sg is null or sg = segment, mxr),
ga as (select scenario, segment, feature, delta_pct, cost_per_user, avg(p) o, avg(pn) s, count(*) n, sum(mv) v from gr group by all),
grid as (select *, greatest(o - s, 0) gain0 from ga)"""
ORACLES.update({
    "whatif": sql(SCORED + """, mxr as (select max(recency) m from u),
        w as (select avg(p) o, avg(least(greatest(recency * 0.7 / m, 0), 1)) s, count(*) n, sum(monetary_velocity) v
          from scored, mxr where segment = 'At Risk')""",
        """select round(o, 3) original_churn, round(s, 3) simulated_churn, n users_affected,
        round((o - s) / greatest(o, 0.001) * 100, 3) churn_reduction_pct, round((o - s) * 100, 3) absolute_reduction,
        round(v * 90 * greatest(o - s, 0), 0) revenue_saved, round(v * 365 * greatest(o - s, 0), 0) ltv_saved,
        'At Risk' segment, 'recency' feature, cast(-30 as double) delta_pct,
        'A 30% decrease in order_delay for ''At Risk'' could reduce churn by ' || printf('%.1f', (o - s) / greatest(o, 0.001) * 100)
          || '%, protecting ₹' || format('{:,}', cast(round(v * 90 * (o - s)) as bigint)) || ' in revenue.' recommendation,
        cast(0 as double) model_evidence_pct from w"""),
    "counterfactual_lift": sql(SCORED + """, mxr as (select max(recency) m from u),
        w as (select count(*) n, avg(p) o, avg(least(recency, 400) / m) s from scored, mxr where p >= 0.3)""",
        "select n risky, round(greatest(0.5, least(25, (o - s) / greatest(o, 0.001) * 100)), 1) lift from w"),
    "whatif_grid": sql(GRID, """select scenario, segment, feature, delta_pct, cost_per_user, round(o, 3) original_churn,
        round(s, 3) simulated_churn, n users_affected, round((o - s) / greatest(o, 0.001) * 100, 3) churn_reduction_pct,
        round((o - s) * 100, 3) absolute_reduction, round(v * 90 * gain0, 0) revenue_saved, round(v * 365 * gain0, 0) ltv_saved from grid"""),
    "campaign_roi": sql(GRID + """, rr as (select *, round(cost_per_user * n) cst, round(v * 365 * gain0) gn from grid)""",
        """select scenario, segment, cst "cost", gn gain, cast(gn > cst * 0.85 as int) is_profitable,
        case when gn > cst * 0.85 then printf('""" + ROI_GOOD + """', printf('%.1f', (o - s) * 100), format('{:,}', cast(gn as bigint)),
            format('{:,}', cast(cst as bigint)))
          else printf('""" + ROI_BAD + """', format('{:,}', cast(cst as bigint)), format('{:,}', cast(gn as bigint))) end explanation,
        round((select avg(p) from scored) - (o - s) * n / (select count(*) from scored), 5) portfolio_churn from rr"""),
    "ab_assign": sql(SCORES + """, ar as (select user_id, row_number() over (order by md5(user_id || ':42')) rk, count(*) over () n
          from users where segment = 'At Risk')""",
        "select user_id, case when rk <= least(n, greatest(100, ceil(n * 0.2))) then 'treatment' else 'control' end arm from ar"),
    "ab_lift": sql("""ar as (select user_id, churned, row_number() over (order by md5(user_id || ':42')) rk, count(*) over () n from lab),
        g as (select count(*) filter (rk <= greatest(100, ceil(n * 0.2))) treated, count(*) filter (rk > greatest(100, ceil(n * 0.2))) control,
          count(*) filter (rk <= greatest(100, ceil(n * 0.2)) and churned = 1) treated_churned,
          count(*) filter (rk > greatest(100, ceil(n * 0.2)) and churned = 1) control_churned from ar),
        r as (select *, treated_churned / treated t, control_churned / control c,
          (treated_churned + control_churned) / (treated + control) po from g)""",
        """select treated, control, treated_churned, control_churned, round(t, 6) treated_rate, round(c, 6) control_rate,
        round(c - t, 6) lift, round((c - t) / sqrt(po * (1 - po) * (1 / treated + 1 / control)), 6) z from r""", CUT),
    "hypothesis_means": sql(SCORED, """select feature, round(avg(v) filter (p >= 0.3), 3) high_risk_mean,
        round(avg(v) filter (p < 0.3), 3) low_risk_mean from (select 'recency' feature, recency v, p from scored union all
        select 'frequency', frequency, p from scored union all select 'monetary', monetary, p from scored) group by 1"""),
    "rule_hypotheses": sql(SEGMENTS + """, ws as (select * from seg order by avg_churn desc, segment limit 1),
        bs as (select * from seg order by avg_churn, segment limit 1)""",
        """select 1 "rank", 'Targeted Retention for ''' || segment || ''' Segment' title,
          'The ''' || segment || ''' segment (' || "count" || ' users) has the highest churn rate at ' || printf('%.1f', avg_churn * 100)
            || '%. Their avg spend is ₹' || format('{:,}', cast(round(avg_monetary) as bigint)) || '.' hypothesis,
          'Reduce churn by 5-8% for ' || "count" || ' users, protecting ~₹'
            || format('{:,}', cast(round(avg_monetary * "count" * 0.05) as bigint)) || ' in revenue.' expected_impact,
          segment driver, 'Critical' impact, 'High' confidence from ws
        union all select 2, 'Address Primary Churn Driver: Recency',
          'Recency is the #1 churn predictor (importance: 41.0%). Users with extreme recency values are disproportionately churning.',
          '3-6% reduction in at-risk user churn within 30 days.', 'Behavioral', 'High', 'High'
        union all select 3, 'Cross-Sell to Retain High-Value Users', '''' || segment || ''' users (churn: ' || printf('%.1f', avg_churn * 100)
          || '%) have high engagement. Expanding their product portfolio could lock in long-term loyalty.',
          'Increase ARPU by 10% and reduce churn by 3-5% through product stickiness.', 'Product Mix', 'Medium', 'Medium'
          from bs where (select count(*) from seg) > 1"""),
    "report_json": sql(SCORED, """select 'segments' section, cast(count(distinct segment) as int) entries from scored
        union all select 'lifecycle_stages', cast(count(distinct lifecycle) as int) from scored
        union all select 'revenue_at_risk', 1"""),
    "users_json": sql(SCORED, "select user_id, segment, lifecycle, round(churn_probability, 6) churn_probability from scored"),
})

# ---- streaming: the bounded twins ----------------------------------------------------------------

ORACLES.update({
    "event_source": """select event_type, case when event_type = 'error' then 'failed' else 'success' end status, count(*) n,
        round(sum(value), 2) total from events group by 1, 2""",
    "event_dedupe": "select event_type, count(*) n from events group by 1",
    "event_counts": """select strftime(d, '%Y-%m-%d %H:%M:%S') day_start, event_type, count(*) events, round(sum(value), 2) total
        from (select *, date_trunc('day', ts) d from events) group by 1, 2""",
    "failure_rate_stream": """select strftime(w, '%Y-%m-%d %H:%M:%S') from_ts, cast(user_id as varchar) user_id, count(*) events,
        round(avg(case when event_type = 'error' then 1 else 0 end), 6) failure_rate
        from (select *, time_bucket(interval 15 minute, ts) - to_minutes(unnest([0, 15, 30, 45])) w from events)
        group by 1, 2""",
    "risk_ledger": """select cast(user_id as varchar) user_id, round(sum(case event_type when 'purchase' then -0.0125
        when 'error' then 0.03 else 0 end), 4) churn_delta, count(*) events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_ts from events group by 1""",
    "ipi_alert": sql(USERS, f"""select user_id, round((mx - last_us) / {DAY}.0, 4) idle_days from u, b
        where (mx - last_us) / {DAY}.0 > greatest(ipi_median, 1) * 0.1""", EV),
    "ipi_alert_timer": sql(USERS, f"""select user_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') last_ts,
        strftime(make_timestamp(us + lim), '%Y-%m-%d %H:%M:%S') due_ts
        from (select r.user_id, us, lead(us) over (partition by r.user_id order by us) nx,
                floor(greatest(ipi_median, 1) * 1.0 * {DAY})::bigint lim from rows0 r join u on u.user_id = r.user_id) g,
          (select (epoch_ms(max(ts)) - 3600000) * 1000 w from tx) b
        where us <= w and case when nx is null or nx > w then us + lim <= w else nx > us + lim end""", EV),
    "live_user_features": sql(USERS, """select user_id, frequency, round(monetary, 4) monetary, round(avg_basket_value, 4) avg_basket_value,
        round(monetary_std, 4) monetary_std, max_spend, min_spend, recency, account_age_days, round(ipi_median, 4) ipi_median,
        round(ipi_std, 4) ipi_std, round(ipi_consistency, 4) ipi_consistency, round(recency_deviation, 4) recency_deviation,
        round(monetary_velocity, 4) monetary_velocity from u""", EV),
    "live_scoring": """select distinct cast(user_id as varchar) user_id, 1 scores, 1 versions, 1 valid from events
        where user_id in (select o_custkey from orders)""",
    "ticker": """select cast(event_id as varchar) event_id, cast(user_id as varchar) user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts
        from events order by events.ts desc, events.event_id desc limit 20""",
})

# ---- plain silhouette, centres, hypotheses, sections as JSON -------------------------------------

ORACLES.update({
    "silhouette_euclidean": sql(SCORES + """,
        st as (select avg(recency) mr, stddev_samp(recency) sr, avg(frequency) mf, stddev_samp(frequency) sf, avg(monetary) mm, stddev_samp(monetary) sm from users),
        pt as (select user_id, r_score c, (recency - mr) / sr x, (frequency - mf) / sf y, (monetary - mm) / sm z from users, st),
        dr as (select * from pt order by md5(user_id || ':42') limit 5000),
        ds as (select a.user_id, a.c own, b.c other, count(*) n, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) t
            from dr a, pt b group by all),
        ab as (select user_id, max(case when own = other and n > 1 then t / (n - 1) end) a, min(case when own <> other then t / n end) b,
            max(case when own = other then n end) k from ds group by 1)""",
        "select round(avg(case when k = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 5) silhouette from ab"),
    "kmeans_nearest": sql(USERS, "select user_id, 1 nearest from u"),
    "require_columns": """select 'orders' source, '' missing, count(*) "rows" from orders union all
        select 'events', '', count(*) from events union all
        select 'customer', 'user_id,timestamp,amount', 0 from (select count(*) from customer)""",
})


def _said(template: str, **columns: str) -> str:
    """SQL text of a wording with its fields filled from columns."""
    parts = []
    for words, field, _spec, _turn in Formatter().parse(template):
        if words:
            parts.append("'" + words.replace("'", "''") + "'")
        if field:
            parts.append(columns[field])
    return " || ".join(parts)


def _hypothesis(rank: int, concept: str, shown: str, a: str, b: str, lift: str, where: str = "true") -> str:
    words = {"f": f"'{shown}'", "fl": f"'{shown.lower()}'", "a": a, "b": b, "lift": f"printf('%.1f', {lift})"}
    title, text, test, stat = (_said(t, **words) for t in HYPOTHESIS_TEXT[(concept, "")][:4])
    return f"""select {rank} "rank", {title} title, {text} hypothesis, {test} test, '{shown}' driver, {stat} stat,
        '{HYPOTHESIS_TEXT[(concept, "")][4]}' impact, cast({lift} as double) expected_lift_pct from hy where {where}"""


def _rupees(value: str) -> str:
    return f"'₹' || format('{{:,}}', cast(trunc({value}) as bigint))"


_HYPOTHESES = """,
mxr as (select max(recency) m from u),
hs as (select avg(recency) hr, avg(frequency) hf, avg(monetary_velocity) hv, avg(p) o from scored where p >= 0.3),
ls as (select avg(monetary_velocity) lv from scored where p < 0.3),
hg as (select *, cast(trunc(greatest(7, hr * 0.8)) as bigint) rg, cast(trunc(greatest(hf + 1, hf * 1.25)) as bigint) fg,
  case when hv < 10 then greatest(hv * 1.2, 50) else hv * 1.2 end vg from hs, ls),
hy as (select hg.*, round(greatest(0.5, least(25, (o - (select avg(least(recency, rg) / m) from scored, mxr, hg where p >= 0.3))
  / greatest(o, 0.001) * 100)), 1) lift from hg)"""
ORACLES["hypotheses"] = sql(SCORED + _HYPOTHESES, " union all ".join([
    _hypothesis(1, "recency", "Recency", "cast(trunc(hr) as bigint)", "rg", "lift"),
    _hypothesis(2, "frequency", "Frequency", "cast(trunc(hf) as bigint)", "fg", "0.5"),
    _hypothesis(3, "monetary", "Velocity", _rupees("hv"), _rupees("vg"), "0.5", "abs(hv - lv) >= lv * 0.05"),
]))


def _section(name: str, source: str, label: str | None = None) -> str:
    """The numbers of another statement's result as rows."""
    item, numbers = (label, f"* exclude {label}") if label else ("''", "*")
    return f"""select '{name}' section, item, field, round(value, 2) "value" from (unpivot
        (select {item} item, cast(columns({numbers}) as double) as "\\0" from ({ORACLES[source]}) t)
        on columns(* exclude item) into name field value value)"""


ORACLES["report_bodies"] = " union all ".join([
    _section("segments", "value_counts_segment", "segment"),
    _section("lifecycle_stages", "value_counts_lifecycle", "lifecycle"),
    _section("kpis", "kpis"),
    _section("risk_counts", "risk_counts"),
    _section("revenue_at_risk", "rar_summary"),
    _section("revenue_by_segment", "rar_by_segment", "segment"),
])
