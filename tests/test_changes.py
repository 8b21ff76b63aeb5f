"""The state machine, by cases and by properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import changes as C

NOW, OLD = "2024-03-10T00:00:00.000Z", "2024-03-01T00:00:00.000Z"


def state(spark, rows):
    return spark.createDataFrame([(i, h, t, OLD, OLD, a, e, None, n) for n, (i, h, t, a, e) in enumerate(rows)], C.STATE_SCHEMA)


def current(spark, rows, snap="s"):
    fields = ", ".join(f"{f} string" for f in C.SNAPSHOT_FIELDS)
    schema = f"job_id string, content_hash string, tracked_hash string, scan_ordinal long, {fields}"
    return spark.createDataFrame([(*r, n, *[snap] * len(C.SNAPSHOT_FIELDS)) for n, r in enumerate(rows)], schema)


def kinds(df):
    return {r.job_id: r.change_type for r in df.collect()}


def test_kinds(spark):
    prior = state(spark, [("a", "h", "t", True, None), ("b", "h", "t", True, None), ("c", "h", "t", False, OLD), ("d", "h", "t", True, None)])
    now = current(spark, [("a", "h", "t"), ("b", "h", "u"), ("c", "h", "u"), ("e", "h", "t")])
    expected = {"a": "UNCHANGED", "b": "UPDATED", "c": "REAPPEARED", "d": "EXPIRED", "e": "NEW"}
    assert kinds(C.classified(now, prior, NOW)) == expected
    del expected["d"]
    assert kinds(C.classified(now, prior, NOW, C.Coverage(False, "failed_pages"))) == expected


def test_coverage_priority():
    full = C.Coverage(True)
    assert full.after_scan(capped=True, failed_pages=2).reason == "max_results_cap"
    assert full.after_scan(failed_pages=1, degraded=True).reason == "failed_pages"
    assert full.after_scan(pagination_known=False).reason == "pagination_metadata_missing"
    assert C.Coverage(False, "no_prior_state").after_scan(capped=True).reason == "no_prior_state"
    assert full.after_scan() == full


def test_reposts_skip_own_id(spark):
    prior = state(spark, [("a", "h", "t", False, OLD), ("b", "h", "t", False, OLD), ("c", "h", "t", True, None), ("x", None, "t", False, OLD)])
    now = current(spark, [("a", "h", "t"), ("n", "h", "t"), ("m", None, "t")])
    assert {r.job_id: r.repost_of_id for r in C.reposts(now, prior).collect()} == {"a": "b", "n": "a"}


def test_pruning_is_strict_and_keeps_unreadable_dates(spark):
    rows = [("a", "h", "t", False, "2024-02-08T23:59:59.999Z"), ("b", "h", "t", False, "2024-02-09T00:00:00.000Z"), ("c", "h", "t", False, "?"),
            ("d", "h", "t", True, None)]
    assert sorted(r.job_id for r in C.pruned(state(spark, rows), NOW).collect()) == ["b", "c", "d"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("uv")), unique_by=lambda r: r[0], max_size=6))
def test_same_batch_twice_is_unchanged(spark, rows):
    batch = current(spark, [(i, "h" + i, t) for i, t in rows])
    empty = C.empty_state(spark)
    first = C.compared(batch, empty, OLD, C.Coverage(False, "no_prior_state"))
    after = C.updated_state(first, empty, OLD)
    assert after.count() == len(rows)
    assert set(kinds(C.classified(batch, after, NOW)).values()) <= {"UNCHANGED"}
    gone = C.classified(batch.limit(0), after, NOW)
    assert set(kinds(gone).values()) <= {"EXPIRED"} and gone.count() == len(rows)


def test_state_after_a_run(spark):
    prior = state(spark, [("a", "h", "t", True, None), ("b", "h", "t", True, None), ("c", "h", "t", False, OLD), ("d", "h", "t", True, None)])
    now = current(spark, [("a", "h", "t"), ("c", "i", "u"), ("e", "h", "t"), ("f", "h", "t")])
    rows = lambda **kw: {r.job_id: (r.content_hash, r.active, r.expired_at, r.last_seen_at, r.ordinal, r.snapshot and r.snapshot.title)
                         for r in C.updated_state(C.compared(now, prior, NOW, kw.pop("coverage", C.Coverage(True))), prior, NOW, **kw).collect()}
    gone = ("h", False, NOW, OLD, 1, None)
    expected = {"a": ("h", True, None, NOW, 0, "s"), "b": gone, "c": ("i", True, None, NOW, 2, "s"), "d": (*gone[:4], 3, None),
                "e": ("h", True, None, NOW, 6, "s"), "f": ("h", True, None, NOW, 7, "s")}
    assert rows() == expected
    kept = {"b": ("h", True, None, OLD, 1, None), "d": ("h", True, None, OLD, 3, None)}
    assert rows(coverage=C.Coverage(False, "failed_pages")) == expected | kept
    # Only e is committed: new ones are not known after the run, known ones stay as they were.
    some = rows(committed=spark.createDataFrame([("e",)], "job_id string"))
    assert some == {"a": ("h", True, None, OLD, 0, None), "b": gone, "c": ("h", False, OLD, OLD, 2, None), "d": (*gone[:4], 3, None),
                    "e": ("h", True, None, NOW, 6, "s")}


def test_first_of_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 9, "y"), ("b", 1, 1, "z")], "id string, q int, p int, v string")
    assert sorted(tuple(r) for r in C.first_of(df, ["id"], "q", "p").collect()) == [("a", 1, 9, "y"), ("b", 1, 1, "z")]


@pytest.mark.parametrize(("incremental", "most", "cap"), [(True, 0, 600), (True, 900, 900), (False, 50, 50), (False, 0, 0)])
def test_scan_cap(incremental, most, cap):
    assert C.scan_cap(incremental, most) == cap
