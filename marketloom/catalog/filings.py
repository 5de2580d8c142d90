"""Filing-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.functions import params as P
from marketloom.functions.numeric import r
from marketloom.operators import facts as A
from marketloom.session import cut_lineage
from marketloom.sources.tables import Market

MEASURES = {**P.DURATION_TAGS, **P.EPS_TAGS, **P.INSTANT_TAGS}
TAGS = [t for tags in MEASURES.values() for t in tags]
VALUE_ROWS = ", ".join(
    f"('{m}', '{t}', {i}, '{'USD/shares' if m in P.EPS_TAGS else 'USD'}', {m in P.INSTANT_TAGS}, {m in P.EPS_TAGS}, {m == 'revenue'})"
    for m, tags in MEASURES.items() for i, t in enumerate(tags, 1))
view("measures", f"SELECT * FROM (VALUES {VALUE_ROWS}) t(measure, tag, prio, unit, instant, latest, is_rev)")
view("filings", f"""WITH o AS (SELECT *, [{', '.join(repr(t) for t in TAGS)}][CAST(o_orderkey % {len(TAGS)} AS INTEGER) + 1] AS tag,
      last_day(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 2 MONTH)
        - CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS end_d FROM orders)
    SELECT CAST(o_custkey % 25 + 1 AS INTEGER) AS entity_id, tag, CASE WHEN tag = 'EarningsPerShareDiluted' THEN 'USD/shares' ELSE 'USD' END AS unit,
      CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN end_d - 364 ELSE end_d - 90 END AS start_d, end_d,
      end_d + CAST(o_orderkey % 60 + 1 AS INTEGER) AS filed_d, CASE WHEN o_orderkey % 29 = 0 THEN 0.0 ELSE o_totalprice END AS val,
      o_orderkey AS pos FROM o""")


def filings(m: Market):
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(t) for t in TAGS])
    quarter_end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    end = F.date_sub(quarter_end, F.when(key % 23 == 0, 1).otherwise(0))
    tag = F.element_at(names, (key % len(TAGS) + 1).cast("int"))
    return m.table("orders").select(
        (F.col("o_custkey") % 25 + 1).cast("int").alias("entity_id"), tag.alias("tag"),
        F.when(tag == "EarningsPerShareDiluted", "USD/shares").otherwise("USD").alias("unit"),
        F.when(key % 41 == 0, None).when(key % 5 == 0, F.date_sub(end, 364)).otherwise(F.date_sub(end, 90)).alias("start_d"),
        end.alias("end_d"), F.date_add(end, (key % 60 + 1).cast("int")).alias("filed_d"),
        F.when(key % 29 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("val"), key.alias("pos"))


def measures(m: Market):
    return A.measure_table(m.spark)


@query("span_counts", """SELECT CASE WHEN end_d - start_d BETWEEN 80 AND 100 THEN 'quarter' WHEN end_d - start_d BETWEEN 340 AND 380 THEN 'annual' END AS span,
    count(*) AS n FROM facts GROUP BY 1""")
def span_counts(m: Market):
    return m.facts.groupBy(A.span().alias("span")).agg(F.count(F.lit(1)).alias("n"))


@query("first_known_values", """SELECT entity_id, tag, end_d, arg_min(val, filed_d * 1000000000 + pos) AS val, min(filed_d) AS filed_d,
    arg_min(start_d, pos) AS start_d FROM (SELECT entity_id, tag, end_d, start_d, val, pos, filed_d, filed_d - DATE '1970-01-01' AS day FROM facts
      WHERE end_d - start_d BETWEEN 80 AND 100) GROUP BY 1, 2, 3""".replace("filed_d * 1000000000 + pos", "day * 1000000000 + pos"), "end_d filed_d start_d")
def first_known_values(m: Market):
    return A.known_values(A.in_span(m.facts, A.QUARTER), ["entity_id", "tag", "end_d"])


@query("latest_known_values", """SELECT entity_id, tag, end_d, arg_max(val, (filed_d - DATE '1970-01-01') * 1000000000 - pos) AS val,
    min(filed_d) AS filed_d FROM facts GROUP BY 1, 2, 3""", "end_d filed_d")
def latest_known_values(m: Market):
    return A.known_values(A.in_span(m.facts, A.INSTANT), ["entity_id", "tag", "end_d"], latest=True).drop("start_d")


view("quarter_known", """SELECT entity_id, tag, prio, end_d, arg_min(val, (filed_d - DATE '1970-01-01') * 1000000000 + pos) AS val,
    min(filed_d) AS filed_d FROM facts WHERE end_d - start_d BETWEEN 80 AND 100 GROUP BY 1, 2, 3, 4""")


@query("priority_values", """SELECT entity_id, end_d, arg_min(val, prio) AS val, arg_min(tag, prio) AS tag, arg_min(filed_d, prio) AS filed_d
    FROM quarter_known GROUP BY 1, 2""", "end_d filed_d")
def priority_values(m: Market):
    known = A.known_values(A.in_span(m.facts, A.QUARTER), ["entity_id", "tag", "prio", "end_d"])
    return A.priority_fold(known, ["entity_id", "end_d"]).select("entity_id", "end_d", "val", "tag", "filed_d")


# the promotion rule as one level per tag: five candidates at most
def _promo_chain() -> str:
    cte = ["w AS (SELECT entity_id, end_d, " + ", ".join(f"max(val) FILTER (WHERE prio = {i}) AS v{i}" for i in range(1, 6))
           + " FROM quarter_known GROUP BY 1, 2)", "s1 AS (SELECT *, v1 AS c1 FROM w)"]
    for i in range(2, 6):
        cte.append(f"s{i} AS (SELECT *, CASE WHEN v{i} IS NULL THEN c{i-1} WHEN c{i-1} IS NULL OR abs(v{i}) > abs(c{i-1}) * 1.5 THEN v{i} ELSE c{i-1} END AS c{i} FROM s{i-1})")
    return ", ".join(cte)


@query("priority_promotion", f"{_promo_chain()} SELECT entity_id, end_d, c5 AS val FROM s5", "end_d")
def priority_promotion(m: Market):
    known = A.known_values(A.in_span(m.facts, A.QUARTER), ["entity_id", "tag", "prio", "end_d"])
    return A.priority_fold(known, ["entity_id", "end_d"], promote=True).select("entity_id", "end_d", "val")


def _series_sql() -> str:
    """Chosen value per (entity, measure, span, end): the fold as five levels."""
    known = """k0 AS (SELECT f.entity_id, s.measure, s.tag, s.prio, s.latest, s.is_rev, s.instant, f.end_d, f.val, f.filed_d, f.pos,
        CASE WHEN NOT s.instant THEN f.start_d END AS start_d,
        CASE WHEN s.instant THEN 'instant' WHEN end_d - start_d BETWEEN 80 AND 100 THEN 'quarter' WHEN end_d - start_d BETWEEN 340 AND 380 THEN 'annual' END AS span
        FROM filings f JOIN measures s ON s.tag = f.tag AND s.unit = f.unit),
      k AS (SELECT entity_id, measure, span, tag, prio, end_d, is_rev, min(filed_d) AS filed_d, arg_min(start_d, pos) AS start_d,
        CASE WHEN latest THEN arg_max(val, (filed_d - DATE '1970-01-01') * 1000000000 - pos)
             ELSE arg_min(val, (filed_d - DATE '1970-01-01') * 1000000000 + pos) END AS val
        FROM k0 WHERE span IS NOT NULL GROUP BY entity_id, measure, span, tag, prio, end_d, is_rev, latest),
      z AS (SELECT * FROM k WHERE NOT (is_rev AND val = 0)),
      w AS (SELECT entity_id, measure, span, end_d, is_rev, """
    known += ", ".join(f"max({{'v': val, 'f': filed_d, 's': start_d, 't': tag}}) FILTER (WHERE prio = {i}) AS p{i}" for i in range(1, 6))
    known += " FROM z GROUP BY 1, 2, 3, 4, 5), s1 AS (SELECT *, p1 AS c1, CASE WHEN p1 IS NULL THEN [] ELSE [p1.t] END AS u1 FROM w)"
    for i in range(2, 6):
        wins = f"p{i} IS NOT NULL AND (c{i-1} IS NULL OR (is_rev AND abs(p{i}.v) > abs(c{i-1}.v) * 1.5))"
        known += (f", s{i} AS (SELECT *, CASE WHEN {wins} THEN p{i} ELSE c{i-1} END AS c{i}, "
                  f"CASE WHEN {wins} THEN list_append(u{i-1}, p{i}.t) ELSE u{i-1} END AS u{i} FROM s{i-1})")
    return f"WITH {known} SELECT entity_id, measure, span, end_d, c5.v AS val, c5.f AS filed_d, c5.s AS start_d, c5.t AS tag, u5 AS used FROM s5"


view("chosen", _series_sql())
view("fy", "SELECT entity_id, end_d AS fy_end, start_d AS fy_start, val AS fy_val, filed_d AS fy_filed FROM chosen WHERE measure = 'revenue' AND span = 'annual'")
view("mistags", """SELECT DISTINCT q.entity_id, q.end_d FROM chosen q JOIN fy ON fy.entity_id = q.entity_id AND q.end_d > fy_start AND q.end_d <= fy_end
    WHERE q.measure = 'revenue' AND q.span = 'quarter' AND fy_val <> 0 AND abs(abs(q.val) / abs(fy_val) - 1) <= 0.05""")
view("rev", """SELECT entity_id, end_d, val, filed_d FROM chosen c WHERE measure = 'revenue' AND span = 'quarter'
    AND NOT EXISTS (SELECT 1 FROM mistags x WHERE x.entity_id = c.entity_id AND x.end_d = c.end_d)""")
_PIVOT = ", ".join(f"max(val) FILTER (WHERE measure = '{n}') AS {n}" for n in [*A.OTHERS, *A.INSTANTS])
view("statements", f"""SELECT r.entity_id, r.end_d AS fiscal_period_end, r.filed_d AS announced_d, r.val AS revenue, net_income, eps_diluted,
      gross_profit / nullif(r.val, 0) AS gross_margin, net_income / nullif(r.val, 0) AS net_margin,
      CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END AS total_debt,
      stockholders_equity, operating_cash_flow - abs(capex) AS free_cash_flow, 'edgar' AS source
    FROM rev r LEFT JOIN (SELECT entity_id, end_d, {_PIVOT} FROM chosen WHERE span <> 'annual' GROUP BY 1, 2) w
      ON w.entity_id = r.entity_id AND w.end_d = r.end_d""")
# planted ends come in pairs one day apart, so a run has at most two rows
view("fundamentals", """SELECT s.*, 'Brand#' || CAST(s.entity_id AS VARCHAR) AS ticker FROM statements s WHERE NOT EXISTS (SELECT 1 FROM statements o WHERE o.entity_id = s.entity_id
    AND abs(o.fiscal_period_end - s.fiscal_period_end) BETWEEN 1 AND 5
    AND (CASE WHEN o.fiscal_period_end > s.fiscal_period_end THEN o.announced_d < s.announced_d ELSE o.announced_d <= s.announced_d END))""")


def fundamentals(m: Market):
    return A.quarterly(filings(m), measures(m)).withColumn("ticker", F.concat(F.lit("Brand#"), F.col("entity_id").cast("string")))


@query("measure_series", "SELECT entity_id, measure, span, end_d, val, filed_d, start_d, tag FROM chosen", "end_d filed_d start_d")
def measure_series(m: Market):
    return A.series(filings(m), measures(m)).drop("used")


@query("contributing_tags", """e AS (SELECT DISTINCT entity_id, measure, unnest(used) AS tag FROM chosen WHERE span <> 'annual')
    SELECT e.entity_id, e.measure, string_agg(e.tag, ',' ORDER BY s.prio) AS tags FROM e JOIN measures s ON s.measure = e.measure AND s.tag = e.tag GROUP BY 1, 2""")
def contributing_tags(m: Market):
    t = A.used_tags(A.series(filings(m), measures(m)), measures(m))
    return t.withColumn("tags", F.array_join("tags", ","))


@query("mistagged_quarters", "SELECT entity_id, end_d FROM mistags", "end_d")
def mistagged_quarters(m: Market):
    chosen = A.series(filings(m), measures(m))
    return A.mistagged(A.quarters_of(chosen), A.years_of(chosen))


_ROUND = ["gross_margin", "net_margin"]


@query("quarterly_fundamentals", """SELECT entity_id, fiscal_period_end, announced_d, revenue, net_income, eps_diluted, round(gross_margin, 6) AS gross_margin,
    round(net_margin, 6) AS net_margin, total_debt, stockholders_equity, round(free_cash_flow, 4) + 0.0 AS free_cash_flow, source FROM fundamentals""", "fiscal_period_end announced_d")
def quarterly_fundamentals(m: Market):
    f = fundamentals(m).drop("ticker")
    return f.withColumns({**{c: F.round(c, 6) for c in _ROUND}, "free_cash_flow": r("free_cash_flow", 4)})


view("open_years", "SELECT * FROM fy WHERE fy_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rev WHERE rev.entity_id = fy.entity_id AND rev.end_d = fy.fy_end)")
view("three", """SELECT o.entity_id, o.fy_end, o.fy_filed, list(r.end_d) AS ends FROM open_years o JOIN rev r ON r.entity_id = o.entity_id
    AND r.end_d > o.fy_start AND r.end_d < o.fy_end GROUP BY 1, 2, 3, o.fy_start HAVING count(*) = 3""")
view("inner_ends", "SELECT entity_id, fy_end, fy_filed, unnest(ends) AS end_d FROM three")


@query("q4_candidates", """o AS (SELECT f.entity_id, s.measure, s.prio, f.filed_d, f.end_d, arg_min(f.val, f.pos) FILTER (WHERE f.end_d - f.start_d BETWEEN 80 AND 100) AS q,
      arg_max(f.val, f.pos) FILTER (WHERE f.end_d - f.start_d BETWEEN 340 AND 380) AS fy FROM filings f JOIN measures s ON s.tag = f.tag AND s.unit = f.unit
      WHERE NOT s.instant AND NOT s.latest GROUP BY 1, 2, 3, 4, 5),
    qs AS (SELECT i.entity_id, i.fy_end, o.measure, o.prio, sum(q) AS qs FROM inner_ends i JOIN o ON o.entity_id = i.entity_id AND o.filed_d = i.fy_filed AND o.end_d = i.end_d
      WHERE q IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) = 3),
    sf AS (SELECT t.entity_id, t.fy_end, o.measure, arg_min(o.fy - qs.qs, o.prio) AS same_filing FROM three t JOIN o ON o.entity_id = t.entity_id AND o.filed_d = t.fy_filed
      AND o.end_d = t.fy_end JOIN qs ON qs.entity_id = t.entity_id AND qs.fy_end = t.fy_end AND qs.measure = o.measure AND qs.prio = o.prio WHERE o.fy IS NOT NULL GROUP BY 1, 2, 3),
    af AS (SELECT i.entity_id, i.fy_end, c.measure, a.val - sum(c.val) AS as_filed FROM inner_ends i JOIN chosen c ON c.entity_id = i.entity_id AND c.end_d = i.end_d AND c.span = 'quarter'
      JOIN chosen a ON a.entity_id = i.entity_id AND a.end_d = i.fy_end AND a.span = 'annual' AND a.measure = c.measure GROUP BY 1, 2, 3, a.val HAVING count(*) = 3)
    SELECT coalesce(sf.entity_id, af.entity_id) AS entity_id, coalesce(sf.fy_end, af.fy_end) AS fy_end, coalesce(sf.measure, af.measure) AS measure,
      round(same_filing, 4) + 0.0 AS same_filing, round(as_filed, 4) + 0.0 AS as_filed,
      coalesce(abs(same_filing - as_filed) / nullif(greatest(abs(same_filing), abs(as_filed)), 0) <= 0.005, FALSE) AS agree
    FROM sf FULL JOIN af ON af.entity_id = sf.entity_id AND af.fy_end = sf.fy_end AND af.measure = sf.measure""", "fy_end")
def q4_candidates(m: Market):
    chosen = cut_lineage(A.series(filings(m), measures(m)), "chosen-facts")
    revenue = A.without_mistagged(A.quarters_of(chosen), A.years_of(chosen))
    c = A.q4_candidates(filings(m), measures(m), chosen, revenue).drop("fy_filed")
    return c.withColumns({"same_filing": r("same_filing", 4), "as_filed": r("as_filed", 4)})


@query("fundamentals_with_derived_q4", dates="fiscal_period_end announced_d")
def fundamentals_with_derived_q4(m: Market):
    return A.quarterly(filings(m), measures(m), derive_q4=True)


@query("fundamentals_yoy", """y AS (SELECT ticker, fiscal_period_end, revenue, revenue / nullif(lag(revenue, 4) OVER w, 0) - 1 AS revenue_yoy,
      net_income / nullif(lag(net_income, 4) OVER w, 0) - 1 AS net_income_yoy, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_period_end DESC) AS age
      FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_period_end))
    SELECT ticker, fiscal_period_end, revenue, round(revenue_yoy, 6) + 0.0 AS revenue_yoy, round(net_income_yoy, 6) + 0.0 AS net_income_yoy,
      CAST(age AS INTEGER) AS age, age <= 20 AS in_chart FROM y""", "fiscal_period_end")
def fundamentals_yoy(m: Market):
    from marketloom.plans.dashboard import fundamentals_history
    h = fundamentals_history(fundamentals(m))
    return h.select("ticker", "fiscal_period_end", "revenue", r("revenue_yoy").alias("revenue_yoy"),
                    r("net_income_yoy").alias("net_income_yoy"), "age", "in_chart")


@query("fundamentals_profile", """SELECT ticker, count(*) AS n, min(fiscal_period_end) AS first_d, max(fiscal_period_end) AS last_d,
    count(net_margin) AS n_margin, count(total_debt / nullif(stockholders_equity, 0)) AS n_leverage FROM fundamentals GROUP BY 1""", "first_d last_d")
def fundamentals_profile(m: Market):
    from marketloom.functions.numeric import ratio
    return fundamentals(m).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("fiscal_period_end").alias("first_d"), F.max("fiscal_period_end").alias("last_d"),
        F.count("net_margin").alias("n_margin"), F.count(ratio("total_debt", "stockholders_equity")).alias("n_leverage"))


def _hist_sql(x: str) -> str:
    return f"""h AS (SELECT {x} AS x FROM fundamentals), b AS (SELECT min(x) AS lo, max(x) AS hi FROM h)
      SELECT CAST(coalesce(least(floor((x - lo) * 20 / nullif(hi - lo, 0)), 19), 0) AS INTEGER) AS bin, count(*) AS n FROM h, b WHERE x IS NOT NULL GROUP BY 1"""


@query("net_margin_histogram", _hist_sql("net_margin"))
def net_margin_histogram(m: Market):
    from marketloom.operators.ranking import range_histogram
    return range_histogram(fundamentals(m), "net_margin", 20)


@query("leverage_histogram", _hist_sql("total_debt / nullif(stockholders_equity, 0)"))
def leverage_histogram(m: Market):
    from marketloom.functions.numeric import ratio
    from marketloom.operators.ranking import range_histogram
    return range_histogram(fundamentals(m).withColumn("x", ratio("total_debt", "stockholders_equity")), "x", 20)
