"""Sources of landed pages, stored states and their leases, and numbers in an order."""

import base64
import json
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_runs import card, pages
from tidemark.operators import changes as C
from tidemark.operators import ordering
from tidemark.plans.pipeline import Landed, run_and_commit, run_once
from tidemark.plans.spec import RunSpec, asked_of
from tidemark.sources import migration, searched, state

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
LATER = NOW + timedelta(hours=1)


# --- pages by what was searched

SEARCHES = ({"workType": ["remote"]}, {"workType": ["remote", "onsite"], "companies": ["7"]}, {"workType": ["onsite"]}, {},
            {"workType": ["hybrid"], "easyApply": True})


def landed(spark, path):
    days = ("2024-01-05", "2024-01-02", "2024-01-05", "2023-12-01", "2024-01-05")
    rows = pages(spark, *((q, s, 200, [card(100 * q + s + i).replace("2024-01-02", d) for i in range(3)]) for q, d in enumerate(days) for s in (0, 10)),
                 (9, 0, 200, []))
    searched.land(rows, searched.searches_table(spark, list(SEARCHES)), path)
    return rows


def taken(df):
    return sorted({r.query_ordinal for r in df.collect()})


def dropped(tmp_path, *queries):
    for query in queries:
        for folder in (tmp_path / "landed").rglob(f"query={query}"):
            shutil.rmtree(folder)


def test_files_of_other_searches_are_not_opened(spark, tmp_path):
    """The files of queries that can't match are gone when a planned scan begins, and it does not notice."""
    path = f"file://{tmp_path}/landed"
    rows = landed(spark, path)
    whole = searched.pages(spark, path)
    assert sorted(whole.select("query_ordinal", "start", "html").collect()) == sorted(rows.select("query_ordinal", "start", "html").collect())
    found = searched.for_search(spark, path, {"workType": ["remote"]}, "2024-01-06T00:00:00.000Z")
    recent = searched.for_search(spark, path, {"workType": ["remote"]}, "2024-01-06T00:00:00.000Z", 2 * 86_400)
    dropped(tmp_path, 2, 4)
    assert taken(found) == [0, 1, 3, 9]
    with pytest.raises(Exception, match="query=[24]"):
        taken(whole)
    dropped(tmp_path, 1, 3)
    assert taken(recent) == [0, 9]


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_filters_are_settled_when_the_scan_is_planned(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    landed(spark, path)
    whole = searched.pages(spark, path)
    assert files_read(whole) == 6 and files_read(whole.where("work_type = '2'")) == 1
    found = searched.for_search(spark, path, {"companies": ["7"], "easyApply": True}, "2024-01-06T00:00:00.000Z", 86_400)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = found._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters") :].split("PushedFilters")[0]
    assert all(c in filters for c in ("company", "easy_apply", "newest"))
    assert files_read(found) == 4 and taken(found) == [0, 2, 4, 9]
    assert taken(whole.where("newest < '2024-01-01'")) == [3] and taken(whole.where("newest > '2024-01-05'")) == [9]
    assert "PushedFilters: [IsNotNull(start), GreaterThanOrEqual(start,10)]" in whole.where("start >= 10")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_landing_again_adds_files(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    landed(spark, path)
    searched.land(pages(spark, (0, 20, 200, [card(1)])), searched.searches_table(spark, list(SEARCHES)), path)
    assert sorted(r.start for r in searched.pages(spark, path).where("query_ordinal = 0").collect()) == [0, 10, 20]
    empty = f"file://{tmp_path}/empty"
    searched.land(pages(spark, (0, 0, 200, [])).limit(0), searched.searches_table(spark, list(SEARCHES)), empty)
    assert searched.pages(spark, empty).count() == 0


def test_queries_that_ask_alike_share_a_folder(spark, tmp_path):
    """As many folders as kinds of searches and days, not as queries."""
    path, days = f"file://{tmp_path}/landed", ("2024-01-05", "2024-01-02")
    rows = pages(spark, *((q, s, 200, [card(100 * q + s).replace("2024-01-02", days[q % 2])]) for q in range(40) for s in (0, 10)))
    searched.land(rows, searched.searches_table(spark, [{"workType": ["remote"]} if q % 4 else {} for q in range(40)]), path)
    assert {f.name for f in (tmp_path / "landed").rglob("query=*")} == {"query=0", "query=1", "query=2"}
    whole = searched.pages(spark, path)
    assert sorted(whole.select("query_ordinal", "start", "html").collect()) == sorted(rows.select("query_ordinal", "start", "html").collect())
    assert taken(whole.where("newest = '2024-01-05'")) == list(range(0, 40, 2)) and taken(whole.where("work_type = 'any'")) == list(range(0, 40, 4))


def test_a_run_over_what_was_landed(spark, tmp_path):
    """Pages are chosen by what was asked, and postings by what they say."""
    path = f"file://{tmp_path}/landed"
    landed(spark, path)
    run = RunSpec.from_dict({"keywords": "x", "workType": ["remote"], "datePosted": "last7d", "maxResults": 4})
    chosen = searched.for_search(spark, path, asked_of(run), "2024-01-06T00:00:00.000Z")
    assert taken(chosen) == [0, 1, 9]
    result = run_once(run, Landed(chosen, own=False), "2024-01-06T00:00:00.000Z")
    assert [(r.sourceJobId, r.postedAt[:10]) for r in result.rows.orderBy("emit_order").collect()] == [
        ("0", "2024-01-05"), ("1", "2024-01-05"), ("2", "2024-01-05"), ("10", "2024-01-05")]
    result.release()


# --- leases and pointers

def rows_of(spark, n):
    return spark.createDataFrame([(f"job-{n}", "c", "t", "a", "b", True, None, None, n)], C.STATE_SCHEMA)


def number_of(store):
    rows, coverage = state.load(store, "k", "f")
    return rows.first().ordinal if coverage.complete else None


def test_a_lease_has_one_holder(spark, tmp_path):
    one, two = (state.Store(spark, f"file://{tmp_path}/state") for _ in range(2))
    assert state.acquire(one, "k", "a", NOW) == (True, "ok") == state.acquire(one, "k", "a", NOW)
    assert state.acquire(two, "k", "b", NOW) == (False, "conflict")
    assert state.acquire(two, "k", "b", LATER) == (True, "stale_override")
    assert state.holds(two, "k", "b") and not state.holds(one, "k", "a")
    assert state.acquire(one, "k", "a", LATER) == (False, "conflict")
    state.release(one, "k", "a")
    assert state.holds(two, "k", "b")
    state.release(two, "k", "b")
    assert not state.holds(two, "k", "b") and state.acquire(one, "k", "a", LATER) == (True, "ok")
    assert state.current_lease(one, "k").number == 2


def test_two_runs_that_take_a_stale_lease_over_at_once(spark, tmp_path, monkeypatch):
    """Both have seen the stale lease before either takes it."""
    one, two = (state.Store(spark, f"file://{tmp_path}/state") for _ in range(2))
    state.acquire(one, "k", "old", NOW)
    seen = state.current_lease(one, "k")
    monkeypatch.setattr(state, "current_lease", lambda *_: seen)
    assert [state.acquire(s, "k", r, LATER) for s, r in ((one, "a"), (two, "b"))] == [(True, "stale_override"), (False, "conflict")]
    monkeypatch.undo()
    assert state.holds(one, "k", "a") and not state.holds(two, "k", "b")


class Paused:
    """A store whose calls run another's step before the n-th of them."""

    def __init__(self, store, at, step):
        self.store, self.left, self.step = store, at, step

    def __getattr__(self, name):
        found = getattr(self.store, name)
        if name not in ("text", "read", "write", "names", "delete", "written_at"):
            return found

        def call(*args, **kwargs):
            self.left -= 1
            if self.left == 0:
                self.step()
            return found(*args, **kwargs)

        return call


def test_a_commit_interleaved_with_a_take_over_at_each_step(spark, tmp_path):
    """What a commit has reported stays in the state; one that was overtaken fails."""
    at, outcomes = 1, []
    while True:
        plain = state.Store(spark, f"file://{tmp_path}/state{at}")
        assert state.acquire(plain, "k", "a", NOW)[0]
        state.commit(plain, "k", "f", rows_of(spark, 1), "1", "a")
        based = []

        def other(plain=plain, based=based):
            assert state.acquire(plain, "k", "b", LATER) == (True, "stale_override")
            based.append(number_of(plain))

        paused = Paused(plain, at, other)
        try:
            state.commit(paused, "k", "f", rows_of(spark, 2), "2", "a")
            good = True
        except state.LeaseLost:
            good = False
        if paused.left > 0:
            assert good and number_of(plain) == 2
            break
        # The run that took over goes on from what it saw, whatever the older one has added since.
        assert number_of(plain) == based[0] and (not good or based[0] == 2)
        state.commit(plain, "k", "f", rows_of(spark, 3), "3", "b")
        assert number_of(plain) == 3
        with pytest.raises(state.LeaseLost):
            state.commit(plain, "k", "f", rows_of(spark, 4), "4", "a")
        assert number_of(plain) == 3
        outcomes.append(good)
        at += 1
    assert at > 6 and outcomes == sorted(outcomes) and len(set(outcomes)) == 2


def test_old_versions_go(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    state.acquire(store, "k", "a", NOW)
    for n in range(6):
        state.commit(store, "k", "f", rows_of(spark, n), "x", "a")
    assert number_of(store) == 5
    assert len(store.names("states_k/pointers")) == state.KEPT and len([n for n in store.names("states_k") if n.startswith("v=")]) == state.KEPT


# --- states of the first layout

def test_older_states_are_reported(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    (tmp_path / "state").mkdir()
    good = {"stateKey": "k", "updatedAt": "x", "jobs": {"b": {"jobId": "b", "active": True}, "a": {"jobId": "a"}}}
    (tmp_path / "state" / "state_k").write_text(json.dumps(good))
    found = state.load_with_migration(store, "k", "f")
    assert (found.migrated, found.migrated_from, found.coverage.reason, found.rows.count()) == (True, "state_k", "no_prior_state", 0)
    state.commit(store, "k", "f", rows_of(spark, 1), "x")
    assert not state.load_with_migration(store, "k", "f").migrated and number_of(store) == 1
    (tmp_path / "state" / "state").mkdir()
    (tmp_path / "state" / "state" / "other").write_text(json.dumps(good | {"version": 1}))
    (tmp_path / "state" / "state_other").write_text(json.dumps(good | {"version": None}))
    assert state.load_with_migration(store, "other", "f").migrated_from == "state/other"


@pytest.mark.parametrize(("value", "kind"), [
    ({"stateKey": "k", "jobs": {}}, "legacy"), ({"version": 1, "stateKey": "k", "jobs": {}}, "legacy"), ({"version": 1.0, "stateKey": "k", "jobs": {}}, "legacy"),
    ({"version": "1", "stateKey": "k", "jobs": {}}, "other"), ({"version": None, "stateKey": "k", "jobs": {}}, "other"), ({"version": True, "stateKey": "k", "jobs": {}}, "other"),
    ({"version": 3, "stateKey": "k", "jobs": {}}, "other"), ({"version": 1, "stateKey": 5, "jobs": {}}, "other"), ({"version": 1, "stateKey": "k"}, "other"),
    ({"version": 1, "stateKey": "k", "jobs": "x"}, "other"), ({"version": 2, "stateKey": "k", "queryFingerprint": "f", "jobs": {"a": {}}}, "current"),
    ({"version": 2, "stateKey": "k", "queryFingerprint": 1, "jobs": {}}, "other"), ({"version": 2, "stateKey": "k", "jobs": {}}, "other"), ([1], "other"), (None, "other"),
])
def test_kinds_of_records(spark, value, kind):
    assert migration.recognised(spark.createDataFrame([("n", json.dumps(value))], migration.RECORD_SCHEMA)).first().kind == kind


def test_entries_keep_the_order_of_the_record(spark):
    jobs = {f"j{(7 * i) % 50:02}": {"jobId": "x", "active": i % 2 == 0, "snapshot": {"title": "T"} if i % 3 else None} for i in range(50)}
    rows = [("state_k", json.dumps({"stateKey": "k", "jobs": jobs})), ("x", None), ("y", "{"), ("z", "")]
    found = migration.entries(spark.createDataFrame(rows, migration.RECORD_SCHEMA)).orderBy("ordinal").collect()
    assert [r.job_id for r in found] == list(jobs) and [r.ordinal for r in found] == list(range(50))
    assert [r.snapshot is None for r in found] == [i % 3 == 0 for i in range(50)]


def test_long_keys_are_hashed(spark):
    row = spark.range(1).select(migration.scoped_name(F.lit("x" * 300), F.lit("f")).alias("a"), migration.scoped_name(F.lit("a?>~b/ü"), F.lit("f")).alias("b")).first()
    assert row.a.startswith("state__h") and len(row.a) == len("state__h") + 40 + 3
    assert row.b == "state__" + base64.urlsafe_b64encode("a?>~b/ü".encode()).decode().rstrip("=") + "__f"


# --- numbers in an order

@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_numbers_are_dense_and_in_order(spark, ranges):
    values = [None, *(((i * 7919) % 1009) ** 3 for i in range(1009)), None]
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = ordering.numbered(rows, "v", "n", ranges).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(values)))
    assert [r.v for r in got] == sorted(v for v in values if v is not None) + [None, None]
    assert ordering.numbered(rows.limit(0), "v", "n", ranges).count() == 0


def test_numbers_need_no_single_task(spark):
    rows = spark.range(10_000).select((F.col("id") * 3).alias("v"))
    found = ordering.numbered(rows, "v", "n", 16)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("n * 3 <> v").count() == 0


def test_places_of_related_pages_do_not_grow_the_state(spark, tmp_path):
    """Many runs with related pages, whose places in a scan are far apart."""
    store = state.Store(spark, f"file://{tmp_path}/state")
    run = RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "maxResults": 0, "discoverRelated": True})
    related = spark.createDataFrame([("1", card(2)), ("1", card(3))], "seed_id string, html string")
    done = run_and_commit(run, Landed(pages(spark, (0, 0, 200, [card(1)])), related=related), "2024-01-03T00:00:00.000Z", store, "k", "f", "r", f"{tmp_path}/out")
    assert done["changes"] == {"NEW": 3} and done["migrated_from"] is None
    assert sorted(r.ordinal for r in state.load(store, "k", "f")[0].collect()) == [0, 1, 2]
