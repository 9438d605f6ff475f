import pytest

from cdcmart.plans import kpis, rollups
from cdcmart.session import shared_folder
from cdcmart.streaming import ingest, maintain
from cdcmart.streaming.commits import Conflict
from helpers import as_set, at, change_table, uid

AS_OF = "2024-02-01 00:00:00"
SOURCES = ("protocol_instances", "step_instances", "deviations")


class Deployment:
    """Changes of the three tables, as states and as what they are."""

    def __init__(self, spark):
        self.spark, self.layout = spark, ingest.Layout(shared_folder(spark, "maintain-test"))
        self.rows = {n: [] for n in SOURCES}

    def arrive(self, **waves):
        for table, rows in waves.items():
            self.rows[table] += rows
            changes = change_table(self.spark, table, *rows)
            name = next(n for n in maintain.ROLLUPS if rollups.ROLLUPS[n][0] == table)
            ingest.store_states(self.spark, self.layout, name, rollups.rollup_partials(name, changes))

    def refresh(self):
        return maintain.refresh_compliance(self.spark, self.layout, AS_OF)

    def check(self):
        tables = {n: change_table(self.spark, n, *rows) for n, rows in self.rows.items()}
        assert as_set(maintain.read_compliance(self.spark, self.layout)) == as_set(kpis.mv_daily_compliance_kpis(tables, AS_OF))


def enrolment(n, protocol, version, status="ACTIVE", **more):
    return {"id": uid(n), "patient_id": f"P{n}", "protocol_definition_id": uid(900 + protocol), "status": status, "enrolled_at": at("2024-01-01T00:00:00"), "_version": version, **more}


def step(n, of, version, state="PENDING", **more):
    return {"id": uid(100 + n), "protocol_instance_id": uid(of), "state": state, "_version": version, **more}


def deviation(n, of, version, kind="MISSED", **more):
    return {"id": uid(500 + n), "protocol_instance_id": uid(of), "deviation_type": kind, "detected_at": at("2024-01-03T00:00:00"), "_version": version, **more}


def test_refreshes_equal_the_full_computation(spark):
    d = Deployment(spark)
    assert maintain.read_compliance(spark, d.layout).count() == 0
    assert d.refresh() == 0
    d.arrive(protocol_instances=[enrolment(n, n % 4, n + 1) for n in range(12)], step_instances=[step(n, n % 12, n + 1) for n in range(30)], deviations=[deviation(1, 0, 1)])
    assert d.refresh() == 4
    d.check()
    assert d.refresh() == 0  # nothing new
    d.check()
    # an update, a delete and a row without a parent yet: one protocol
    d.arrive(step_instances=[step(3, 3, 100, "COMPLETED", completion_status="LATE")], deviations=[deviation(2, 3, 101, "OVERDUE"), deviation(9, 50, 102)])
    assert d.refresh() == 1
    d.check()
    d.arrive(deviations=[deviation(1, 0, 103, _is_deleted=True)], step_instances=[step(4, 4, 0, "MISSED")])  # the step's version is older than what is stored
    assert d.refresh() == 1
    d.check()
    # one moves to another protocol, the late parent comes, a protocol loses its last enrolments
    d.arrive(protocol_instances=[enrolment(1, 2, 200), enrolment(50, 3, 201), *[enrolment(n, 0, 300 + n, _is_deleted=True) for n in (0, 4, 8)]])
    assert d.refresh() == 4
    d.check()
    # states are merged, with and without new ones among them
    ingest.merge_aggregate(spark, maintain.STEPS, d.layout)
    assert d.refresh() == 0
    d.arrive(step_instances=[step(40, 2, 400)])
    ingest.merge_aggregate(spark, maintain.STEPS, d.layout)
    assert d.refresh() >= 1
    d.check()


def test_a_refresh_reads_no_changelog(spark):
    d = Deployment(spark)
    d.arrive(protocol_instances=[enrolment(1, 1, 1), enrolment(2, 2, 2)], step_instances=[step(1, 1, 3)], deviations=[deviation(1, 2, 4)])
    ingest.load(spark, d.layout, "step_instances", change_table(spark, "step_instances", step(1, 1, 3)))
    protocols = maintain.touched_protocols(spark, d.layout, 0)
    files = maintain.recomputed(spark, d.layout, protocols, AS_OF).inputFiles()
    assert files and all("/partials/" in f for f in files)


def test_of_two_refreshes_one_is_refused_and_a_rebuild_starts_over(spark, monkeypatch):
    d = Deployment(spark)
    d.arrive(protocol_instances=[enrolment(1, 1, 1)], step_instances=[step(1, 1, 2)], deviations=[deviation(1, 1, 3)])
    real, inner = maintain.recomputed, []

    def meanwhile(*args):
        if not inner:
            inner.append(1)
            d.refresh()
        return real(*args)

    monkeypatch.setattr(maintain, "recomputed", meanwhile)
    with pytest.raises(Conflict):
        d.refresh()
    monkeypatch.undo()
    d.check()
    d.rows = {"protocol_instances": [enrolment(7, 5, 10)], "step_instances": [step(7, 7, 11)], "deviations": [deviation(7, 7, 12)]}
    ingest.rebuild(spark, d.layout, {n: change_table(spark, n, *rows) for n, rows in d.rows.items()})
    assert d.refresh() == 1
    d.check()
