"""Order of the sorted reports, which comparisons of rows as sets do not see."""

from cdcmart.plans import reports
from helpers import at, tables, uid


def adoption(spark):
    rows = [("F3", 20.0, 8), ("F1", 80.0, 2), ("F2", 20.0, 8), ("F4", 95.0, 9)]
    columns = "snapshot_date date, facility_id string, expected_patients_per_day int, actual_patients bigint, adoption_rate_pct double, reporting_gap int"
    day = at("2024-01-10T00:00:00").date()
    return spark.createDataFrame([(day, f, 10, 2, rate, gap) for f, rate, gap in rows], columns).repartition(4)


def facilities(spark, names):
    return tables(spark, facility=[{"id": uid(n), "facility_id": f, "facility_name": name} for n, (f, name) in enumerate(names)])


def test_worst_gap_first_and_best_rate_first(spark):
    t = facilities(spark, [("F1", "one"), ("F2", "two")])
    worst = [r.facility_id for r in reports.dash_adoption_overview(adoption(spark), t, "2024-01-10").collect()]
    best = [r.facility_id for r in reports.adoption_table(adoption(spark), t, "2024-01-10").collect()]
    assert worst == ["F4", "F2", "F3", "F1"] and best == ["F4", "F1", "F2", "F3"]


def test_two_rows_of_a_facility_repeat_nothing(spark):
    t = facilities(spark, [("F1", "b"), ("F1", "a")])
    rows = reports.adoption_table(adoption(spark), t, "2024-01-10").collect()
    assert len(rows) == 4 and [r.facility_name for r in rows if r.facility_id == "F1"] == ["a"]
