import pytest

from cdcmart.operators.lookup import lookup
from cdcmart.session import shared_folder
from cdcmart.streaming import ingest
from cdcmart.streaming.dimension import Dimension, age, renew, rows_for
from helpers import as_set, change_table, uid

FACILITIES = Dimension("roster", "facility", ("id",), ("facility_id", "facility_name"), max_age_seconds=300, buckets=16)


@pytest.fixture
def layout(spark):
    return ingest.Layout(shared_folder(spark, "dimension-test"))


def facility(n, version, name="first", **more):
    return {"id": uid(n), "facility_id": f"F{n}", "facility_name": name, "_version": version, **more}


def test_stale_renewed_and_missing_rows(spark, layout):
    def names(*ids):
        batch = spark.createDataFrame([(uid(n),) for n in ids], "key string")
        found = lookup(batch, rows_for(spark, layout, FACILITIES, batch.selectExpr("key AS id")), {"key": "id"}, {"facility_name": "unknown"})
        return {int(r.key[-4:]): r.facility_name for r in found.collect()}

    assert names(1) == {1: "unknown"} and age(spark, layout, FACILITIES) == float("inf")
    ingest.load(spark, layout, "facility", change_table(spark, "facility", *[facility(n, n + 1) for n in range(30)]))
    assert renew(spark, layout, FACILITIES, now=1000)
    assert names(1, 2, 99) == {1: "first", 2: "first", 99: "unknown"}
    ingest.load(spark, layout, "facility", change_table(spark, "facility", facility(1, 100, "second"), facility(2, 0, "older"), facility(40, 101), facility(3, 102, _is_deleted=True)))
    assert not renew(spark, layout, FACILITIES, now=1299)  # young enough
    assert names(1, 3, 40) == {1: "first", 3: "first", 40: "unknown"}
    before = layout.log(spark).folders(FACILITIES.folder)
    assert renew(spark, layout, FACILITIES, now=1300) and age(spark, layout, FACILITIES, now=1310) == 10
    assert names(1, 2, 3, 40) == {1: "second", 2: "first", 3: "unknown", 40: "first"}
    assert set(before) & set(layout.log(spark).folders(FACILITIES.folder))  # buckets without a change stay as they are
    ingest.load(spark, layout, "facility", change_table(spark, "facility", facility(3, 90, "late")))
    assert renew(spark, layout, FACILITIES, now=2000) and names(3) == {3: "unknown"}  # deleted stays deleted
    assert renew(spark, layout, FACILITIES, now=3000) and rows_for(spark, layout, FACILITIES).count() == 30


def test_a_lookup_reads_the_buckets_of_its_keys_only(spark, layout):
    ingest.load(spark, layout, "facility", change_table(spark, "facility", *[facility(n, n + 1) for n in range(200)]))
    renew(spark, layout, FACILITIES)
    one = rows_for(spark, layout, FACILITIES, spark.createDataFrame([(uid(7),)], "id string"))
    assert len(one.inputFiles()) == 1 < len(rows_for(spark, layout, FACILITIES).inputFiles()) and (uid(7),) in as_set(one.select("id"))


def test_a_rebuild_makes_the_snapshot_stale_and_of_two_renewals_one_counts(spark, layout, monkeypatch):
    ingest.load(spark, layout, "facility", change_table(spark, "facility", facility(1, 1), facility(2, 2)))
    assert renew(spark, layout, FACILITIES)
    ingest.rebuild(spark, layout, {"facility": change_table(spark, "facility", facility(5, 1))})
    assert age(spark, layout, FACILITIES) == float("inf") and renew(spark, layout, FACILITIES)
    assert as_set(rows_for(spark, layout, FACILITIES).select("id")) == {(uid(5),)}
    from cdcmart.streaming import dimension

    real, inner = dimension.folders_of, []

    def meanwhile(*args):
        if not inner:
            inner.append(None)
            inner[0] = renew(spark, layout, FACILITIES, now=9e9)
        return real(*args)

    monkeypatch.setattr(dimension, "folders_of", meanwhile)
    assert not renew(spark, layout, FACILITIES, now=9e9) and inner == [True]
    assert rows_for(spark, layout, FACILITIES).count() == 1
