import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import facts as A

FACT = "entity_id string, tag string, unit string, start_d date, end_d date, val double, filed_d date, pos int"
D = dt.date.fromisoformat


def known(frame, rows, kind=A.QUARTER, latest=False):
    df = frame([("E", "T", "USD", *r) for r in rows], FACT)
    out = A.known_values(A.in_span(df, kind), ["entity_id", "tag", "end_d"], latest=latest)
    return {r.end_d: r for r in out.collect()}


def test_first_filing_wins_for_amounts(frame):
    rows = [("2012-01-01", "2012-03-31", 13185.0, "2012-04-27", 0), ("2012-01-01", "2012-03-31", 9857.0, "2013-01-30", 1)]
    got = known(frame, rows)[D("2012-03-31")]
    assert (got.val, got.filed_d) == (13185.0, D("2012-04-27"))


def test_latest_filing_wins_per_share_in_any_order(frame):
    rows = [("2013-09-29", "2013-12-28", 14.50, "2014-01-28", 0), ("2013-09-29", "2013-12-28", 2.07, "2014-10-27", 1)]
    for order in (rows, [(*r[:4], 1 - r[4]) for r in reversed(rows)]):
        got = known(frame, order, latest=True)[D("2013-12-28")]
        assert (got.val, got.filed_d) == (2.07, D("2014-01-28"))


def test_year_to_date_is_not_a_quarter(frame):
    rows = [("2012-01-01", "2012-09-30", 40000.0, "2012-10-25", 0), ("2012-07-01", "2012-09-30", 13806.0, "2012-10-25", 1)]
    got = known(frame, rows)
    assert len(got) == 1 and got[D("2012-09-30")].val == 13806.0
    assert got[D("2012-09-30")].start_d == D("2012-07-01")


def test_same_filing_keeps_payload_order(frame):
    rows = [("2012-01-01", "2012-03-31", 1.0, "2012-04-27", 5), ("2012-01-01", "2012-03-31", 2.0, "2012-04-27", 3)]
    assert known(frame, rows)[D("2012-03-31")].val == 2.0
    assert known(frame, rows, latest=True)[D("2012-03-31")].val == 2.0


KNOWN = "entity_id string, end_d date, prio int, tag string, val double, filed_d date, start_d date"


def fold(frame, values, **flags):
    rows = [("E", end, prio, f"T{prio}", val, "2020-01-01", None) for end, prio, val in values]
    out = A.priority_fold(frame(rows, KNOWN), ["entity_id", "end_d"], **flags).collect()
    return {r.end_d.isoformat(): (r.val, r.used) for r in out}


def test_priority_fills_disjoint_periods(frame):
    got = fold(frame, [("2016-03-31", 2, 100.0), ("2019-03-31", 1, 200.0)])
    assert got == {"2016-03-31": (100.0, ["T2"]), "2019-03-31": (200.0, ["T1"])}


def test_priority_beats_a_slightly_larger_value(frame):
    for promote in (False, True):
        assert fold(frame, [("2014-03-31", 1, 29000.0), ("2014-03-31", 2, 33000.0)], promote=promote)["2014-03-31"][0] == 29000.0


def test_subline_is_promoted(frame):
    got = fold(frame, [("2010-02-28", 1, 458e6), ("2010-02-28", 2, 6404e6)], promote=True)["2010-02-28"]
    assert got == (6404e6, ["T1", "T2"])


def test_promotion_compares_with_the_chosen_value(frame):
    got = fold(frame, [("2010-02-28", 1, 100.0), ("2010-02-28", 2, 200.0), ("2010-02-28", 3, 250.0)], promote=True)
    assert got["2010-02-28"][0] == 200.0


def test_zero_can_be_skipped(frame):
    assert fold(frame, [("2009-02-28", 1, 0.0), ("2009-02-28", 2, 5453e6)], skip_zero=True)["2009-02-28"][0] == 5453e6


def test_mistagged_annual_is_dropped(frame):
    q = frame([("E", "2020-05-31", 39068.0, "2020-06-20"), ("T", "2012-12-31", 306332.0, "2013-02-01"),
               ("O", "2010-02-28", 5858e6, "2010-03-20")], "entity_id string, end_d date, val double, filed_d date")
    y = frame([("E", "2020-05-31", "2019-06-01", 39068.0, "2020-06-20"), ("T", "2012-12-31", "2012-01-01", 413256.0, "2013-02-01"),
               ("O", "2010-05-31", "2009-06-01", 2290e6, "2010-07-01"), ("T", "2012-12-31", None, 306332.0, "2013-02-01")],
              "entity_id string, fy_end date, fy_start date, fy_val double, fy_filed date")
    assert {r.entity_id for r in A.without_mistagged(q, y).collect()} == {"T", "O"}


ROW = "entity_id string, fiscal_period_end date, announced_d date, revenue double"


def collapse(frame, rows):
    return sorted(r.fiscal_period_end.isoformat() for r in A.collapse_near_ends(frame([("E", *r) for r in rows], ROW)).collect())


def test_near_ends_keep_the_first_announced(frame):
    assert collapse(frame, [("2010-07-31", "2012-03-13", 1.0), ("2010-08-01", "2010-08-30", 1.0)]) == ["2010-08-01"]


def test_real_neighbours_stay(frame):
    assert len(collapse(frame, [("2010-05-02", "2010-05-30", 1.0), ("2010-08-01", "2010-08-30", 1.0)])) == 2


def test_chain_is_measured_from_the_kept_end(frame):
    # 1, 4 and 8: the 4th falls to the 1st, and the 8th is then 7 days away
    rows = [("2010-08-01", "2010-08-30", 1.0), ("2010-08-04", "2010-09-30", 1.0), ("2010-08-08", "2010-09-30", 1.0)]
    assert collapse(frame, rows) == ["2010-08-01", "2010-08-08"]
    # the 4th is announced first and stays, so the 8th is its neighbour
    rows[1] = ("2010-08-04", "2010-08-15", 1.0)
    assert collapse(frame, rows) == ["2010-08-04"]


def year(tag="Revenues", q4=None, last=400.0, restate=True):
    ends = [("2020-01-01", "2020-03-31", 100.0), ("2020-04-01", "2020-06-30", 110.0), ("2020-07-01", "2020-09-30", 120.0)]
    rows = [("E", tag, "USD", s, e, v, "2020-11-01", i) for i, (s, e, v) in enumerate(ends)]
    if restate:
        rows += [("E", tag, "USD", s, e, v, "2021-02-15", 10 + i) for i, (s, e, v) in enumerate(ends)]
    rows.append(("E", tag, "USD", "2020-01-01", "2020-12-31", last, "2021-02-15", 20))
    if q4:
        rows.append(("E", tag, "USD", "2020-10-01", "2020-12-31", q4, "2021-02-15", 21))
    return rows


def derive(spark, frame, rows):
    out = A.quarterly(frame(rows, FACT), A.measure_table(spark), derive_q4=True)
    return {r.fiscal_period_end.isoformat(): (r.revenue, r.source) for r in out.collect()}


def test_fourth_quarter_is_derived_when_both_ways_agree(spark, frame):
    got = derive(spark, frame, year())
    assert got["2020-12-31"] == (70.0, "edgar_derived") and len(got) == 4


def test_fourth_quarter_needs_the_same_filing(spark, frame):
    assert "2020-12-31" not in derive(spark, frame, year(restate=False))


def test_filed_fourth_quarter_is_kept(spark, frame):
    assert derive(spark, frame, year(q4=71.0))["2020-12-31"] == (71.0, "edgar")


def test_disagreeing_reconstructions_give_nothing(spark, frame):
    rows = year()
    rows[3] = (*rows[3][:5], 150.0, *rows[3][6:])  # the annual filing restates Q1
    assert "2020-12-31" not in derive(spark, frame, rows)


def test_no_facts_no_rows(spark, frame):
    assert A.quarterly(frame([], FACT), A.measure_table(spark)).count() == 0


def test_free_cash_flow_and_debt(spark, frame):
    end = ("2020-01-01", "2020-03-31")
    rows = [("E", "Revenues", "USD", *end, 100.0, "2020-05-01", 0), ("E", "GrossProfit", "USD", *end, 40.0, "2020-05-01", 1),
            ("E", "NetCashProvidedByUsedInOperatingActivities", "USD", *end, 30.0, "2020-05-01", 2),
            ("E", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", *end, -8.0, "2020-05-01", 3),
            ("E", "DebtCurrent", "USD", None, "2020-03-31", 5.0, "2020-05-01", 4)]
    r = A.quarterly(frame(rows, FACT), A.measure_table(spark)).first()
    assert (r.gross_margin, r.free_cash_flow, r.total_debt, r.net_margin, r.source) == (0.4, 22.0, 5.0, None, "edgar")


def test_used_tags_are_in_priority_order(spark, frame):
    rows = [("E", "Revenues", "USD", "2016-01-01", "2016-03-31", 100.0, "2016-05-01", 0),
            ("E", "SalesRevenueNet", "USD", "2019-01-01", "2019-03-31", 200.0, "2019-05-01", 1)]
    m = A.measure_table(spark)
    got = A.used_tags(A.series(frame(rows, FACT), m), m).filter(F.col("measure") == "revenue").first()
    assert got.tags == ["SalesRevenueNet", "Revenues"]
