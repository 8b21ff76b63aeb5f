"""Whole runs over landed pages, state on disk, streams, specs and sinks."""

import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators import html as H
from tidemark.operators import statistics as S
from tidemark.plans import registry, sinks, spec
from tidemark.plans.pipeline import AllTargetsFailed, Landed, RunFailed, items_of, run_and_commit, run_incremental, run_once
from tidemark.sources import landing, runs, state
from tidemark.streaming.runs import stream_runs


def card(i, title="Engineer", company="Acme"):
    return (f'<li><div data-entity-urn="urn:li:jobPosting:{i}" data-tracking-id="t"><a class="base-card__full-link" href="https://p/view/{i}?x=1">'
            f'</a><h3 class="base-search-card__title">{title}</h3><h4 class="base-search-card__subtitle"><a href="https://p/company/acme">{company}</a>'
            f'</h4><span class="job-search-card__location">Berlin, Germany</span><time datetime="2024-01-02"></time></div></li>')


def pages(spark, *rows):
    return spark.createDataFrame([(q, s, h, None, "".join(c)) for q, s, h, c in rows], landing.PAGE_SCHEMA)


SPEC = spec.RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "emitExpired": True, "emitUnchanged": True, "maxResults": 0})


def test_first_query_wins_and_failed_page_ends(spark):
    landed = pages(spark, (0, 0, 200, [card(i) for i in range(10)]), (0, 10, 503, []), (0, 20, 200, [card(99)]), (1, 0, 200, [card(3, "Other"), card(50)]))
    found = {r.sourceJobId: r.title for r in landing.scan_cards(landed).collect()}
    assert set(found) == {*map(str, range(10)), "50"} and found["3"] == "Engineer"
    outcome = {r.query_ordinal: (r.rows, r.failed, r.drifted) for r in landing.query_outcomes(landed).collect()}
    assert outcome == {0: (10, True, False), 1: (2, False, False)}


def test_drift_is_seen(spark):
    page = spark.createDataFrame([('<div data-entity-urn="urn:li:jobPosting:1"></div>',)], "html string")
    assert H.page_facts(page).first().drifted


def test_run_once_limits_and_shapes(spark):
    landed = Landed(pages(spark, (0, 0, 200, [card(i, company="Best Staffing" if i % 2 else "Acme") for i in range(8)])))
    run = spec.RunSpec.from_dict({"keyword": " x ", "removeAgency": True, "maxResults": 3, "compact": True, "descriptionFormat": "text"})
    rows = run_once(run, landed, "2024-01-03T00:00:00.000Z").rows.orderBy("emit_order").collect()
    assert [r.sourceJobId for r in rows] == ["0", "2", "4"]
    assert rows[0].country == "DE" and "descriptionHtml" not in rows[0].asDict() and rows[0].postedAt == "2024-01-02T00:00:00.000Z"


def test_no_target_is_an_empty_success(spark):
    result = run_once(spec.RunSpec.from_dict({"easyApply": True}), Landed(pages(spark, (0, 0, 200, [card(1)]))), "2024-01-03T00:00:00.000Z")
    assert result.rows.count() == 0 and result.coverage.complete


def test_incremental_runs_and_lease(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    one = Landed(pages(spark, (0, 0, 200, [card(1), card(2), card(3)])))
    two = Landed(pages(spark, (0, 0, 200, [card(1), card(2, "New title")])))
    a = run_and_commit(SPEC, one, "2024-01-03T00:00:00.000Z", store, "k", "f", "r1", f"{tmp_path}/out1")
    assert a["changes"] == {"NEW": 3} and a["coverage"].reason == "no_prior_state"
    b = run_and_commit(SPEC, two, "2024-01-04T00:00:00.000Z", store, "k", "f", "r2", f"{tmp_path}/out2")
    assert b["changes"] == {"UNCHANGED": 1, "UPDATED": 1, "EXPIRED": 1} and b["coverage"].complete
    rows = {r.sourceJobId: (r.changeType, r.emit_order) for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert rows["3"] == ("EXPIRED", -1) and rows["1"][0] == "UNCHANGED"
    assert state.load(store, "k", "other")[1].reason == "state_corruption_detected"
    assert state.acquire(store, "k", "r3") == (True, "ok") and state.acquire(store, "k", "r4") == (False, "conflict")
    assert run_and_commit(SPEC, two, "2024-01-05T00:00:00.000Z", store, "k", "f", "r5", f"{tmp_path}/out3") == {"status": "busy", "reason": "conflict"}


def test_stream_of_runs(spark, tmp_path):
    landed = f"{tmp_path}/landed"
    pages(spark, (0, 0, 200, [card(1), card(2)])).coalesce(1).write.parquet(landed)
    store = state.Store(spark, f"file://{tmp_path}/state")
    start = lambda: stream_runs(spark, landed, SPEC, store, "k", "f", f"{tmp_path}/out", f"{tmp_path}/check",
                                lambda n: f"2024-01-0{n + 1}T00:00:00.000Z")
    start().awaitTermination(120)
    pages(spark, (0, 0, 200, [card(2)])).coalesce(1).write.mode("append").parquet(landed)
    start().awaitTermination(120)
    kinds = {r.job_id: r.active for r in state.load(store, "k", "f")[0].collect()}
    assert sorted(kinds.values()) == [False, True]


def test_spec_and_searches():
    run = spec.RunSpec.from_dict({"searchString": "  data   engineer ", "regions": ["at", "AT", "xx"], "companies": ["1", "a", "1"], "junk": 1})
    assert (run.keywords, run.regions, run.companies) == ("data engineer", ["AT", "XX"], ["1"])
    assert [(s["geoId"], hint) for s, hint in spec.searches(run)] == [("103883259", "AT")]
    pasted = spec.RunSpec.from_dict({"startUrls": [{"url": "https://de.linkedin.com/jobs/search?keywords=a&f_WT=2,9&f_SB2=3&sortBy=R"}]})
    found, _ = spec.searches(pasted)[0]
    assert (found["keywords"], found["workType"], found["salaryMin"], found["sortBy"], found["linkedinHost"]) == ("a", ["remote"], 80000, "relevant", "de")
    with pytest.raises(ValueError, match="search addresses"):
        spec.parse_search_url("https://example.org/jobs/search", run)
    url = spec.search_url({"keywords": "a b", "workType": ["remote"], "salaryMin": 85000, "easyApply": True}, 10)
    assert "keywords=a+b" in url and "f_WT=2" in url and "f_SB2=3" in url and "f_AL=true" in url and "start=10" in url
    assert spec.salary_step(39_999) is None and spec.salary_step(1e9) == 7


def test_keys_and_fingerprints():
    same = {"b": [3, 1], "a": "x", "c": None, "d": ""}
    assert spec.filter_fingerprint(same) == spec.filter_fingerprint({"a": "x", "b": [1, 3]}) and spec.filter_fingerprint({"a": ""}) == "nofilter"
    assert spec.state_key("C++", None) != spec.state_key("C#", None) and spec.state_key("C++", "Wien").startswith("incremental_c_wien_")
    assert spec.query_fingerprint({"a": [1, 2]}, ["a"]) != spec.query_fingerprint({"a": [2, 1]}, ["a"])
    assert len(spec.storage_name("state", "x" * 400)) < 60
    assert spec.canonical_url("HTTPS://A.io/p?b=2&utm_source=x&a=1#f").endswith("/p?a=1&b=2")
    assert spec.redacted({"apiKey": "s", "q": [{"token": "t"}]}) == {"apiKey": "[redacted]", "q": [{"token": "[redacted]"}]}


def test_messages():
    row = {"title": "A_b", "applyUrl": "https://p/1", "company": "C", "location": "L", "employmentType": None, "description": "d" * 400, "postedAt": "2024-01-02T",
           "changeType": "NEW", "salary": "$1", "line": "C · $1", "line_md": "C · $1", "line_slack": "C · $1", "title_md": "A\\_b", "title_slack": "A_b"}
    assert sinks.telegram([row], "x", 1).splitlines()[2] == "*A\\_b*"
    assert sinks.slack([row])["blocks"][0]["text"]["text"] == "*<https://p/1|A_b>*\nC · $1"
    batches = sinks.discord([row] * 23, "x", 23)
    assert [len(b["embeds"]) for b in batches] == [10, 10, 3] and batches[0]["embeds"][0]["description"].endswith("…")
    sent, failed = sinks.notify([row], {"slack": lambda p: None, "webhook": lambda p: 1 / 0}, "x", 1)
    assert sent == ["slack"] and "division" in failed["webhook"]
    sent, failed = sinks.notify([row], {"slack": lambda p: time.sleep(2), "webhook": lambda p: None}, "x", 1, seconds=0.3)
    assert sent == ["webhook"] and "no answer" in failed["slack"]
    assert max(map(len, sinks.whatsapp([row | {"title": "t" * 5000}]))) == 4096


def test_export():
    records = [{"title": "A|b", "n": 1, "x": None}, {"title": "[c]", "n": 2}]
    calls = []
    done = sinks.export(records, ["notion-search", "notion-create-pages"], lambda t, a: calls.append((t, a)), "jobs", "sql", cap=1)
    assert done == {"exported": 1, "errors": 0, "skipped": 1, "target": "notion"} and "A\\|b" in calls[0][1]["pages"][0]["content"]
    assert sinks.export(records, ["create_issue_label"], print)["target"] == "none"
    assert sinks.export(records, ["append_row"], lambda t, a: {"isError": True})["errors"] == 2
    assert sinks.digest(records, "jobs", "sql", "Wien").startswith('Found 2 jobs for "sql" in Wien.')


def test_csv_and_json_sinks(spark, tmp_path):
    rows = run_once(SPEC, Landed(pages(spark, (0, 0, 200, [card(1)]))), "2024-01-03T00:00:00.000Z").rows
    sinks.write(rows, f"{tmp_path}/csv", "csv")
    sinks.write(rows, f"{tmp_path}/json", "json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 1
    line = spark.read.text(f"{tmp_path}/json").first().value
    assert "description" not in json.loads(line) and json.loads(line)["easyApply"] is False
    assert C.Coverage(True).complete


def test_all_failed_targets_fail_the_run(spark, tmp_path):
    down = Landed(pages(spark, (0, 0, 503, []), (1, 0, 429, [])))
    with pytest.raises(AllTargetsFailed):
        run_once(SPEC, down, "2024-01-03T00:00:00.000Z")
    store = state.Store(spark, f"file://{tmp_path}/state")
    with pytest.raises(RunFailed, match="all search targets failed"):
        run_and_commit(SPEC, down, "2024-01-03T00:00:00.000Z", store, "k", "f", "r1", f"{tmp_path}/out")
    assert not state.holds(store, "k", "r1")
    some = Landed(pages(spark, (0, 0, 503, []), (1, 0, 200, [card(1)])))
    assert run_once(SPEC, some, "2024-01-03T00:00:00.000Z").rows.count() == 1
    empty = Landed(pages(spark, (0, 0, 200, []), (1, 0, 400, [])))
    assert run_once(SPEC, empty, "2024-01-03T00:00:00.000Z").rows.count() == 0


def persisted(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs())


def test_a_run_says_how_it_went(spark, tmp_path):
    before = persisted(spark)
    store = state.Store(spark, f"file://{tmp_path}/state")
    run = spec.RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "maxResults": 0})
    landed = Landed(pages(spark, *((q, 0, 200, [card(10 * q + i) for i in range(10)]) for q in range(3))))
    one = run_and_commit(run, landed, "2024-01-03T00:00:00.000Z", store, "k", "f", "r1", f"{tmp_path}/one", price=0.1)
    assert one["summary"].items() >= {"emitted": 30, "unchangedSkipped": 0, "totalReviews": 30, "ok": True}.items() and one["savings"] is None
    two = run_and_commit(run, landed, "2024-01-04T00:00:00.000Z", store, "k", "f", "r2", f"{tmp_path}/two", price=0.1)
    assert two["summary"]["emitted"] == 0 and two["savings"] == {"saved": 3.0, "percent": 100, "skipped": 30}
    assert persisted(spark) <= before
    assert S.run_summary(0, 0, 5)["reason"] == "no_results" and S.savings(5, 5, 0.1) is None


@pytest.mark.parametrize("name", ["enrichment_limit", "run_sequence", "run_over_other_pages"])
def test_queries_on_runs_leave_nothing_persisted(spark, small, name):
    before = persisted(spark)
    registry.queries()[name](spark, small).count()
    assert persisted(spark) <= before


def test_cards_are_kept_and_only_pages_of_the_first_are_joined(spark):
    """Not all columns of all postings; and no posting loses its key in the join of details, where those without one would gather."""
    run = spec.RunSpec.from_dict({"keywords": "x", "enrichDetails": True, "maxResults": 2})
    details = spark.createDataFrame([(str(i), '<div class="show-more-less-html__markup">Text</div><button>') for i in range(9)], landing.DETAIL_SCHEMA)
    landed, held = Landed(pages(spark, (0, 0, 200, [card(i) for i in (5, 3)]), (1, 0, 200, [card(i) for i in (5, 8, 7)])), details), []
    items = items_of(run, landed, "2024-01-03T00:00:00.000Z", held)
    assert {r.sourceJobId: r.description for r in items.collect()} == {"5": "Text", "3": "Text", "8": None, "7": None}
    assert len(held) == 1 and "title" in held[0].columns and "skills" not in held[0].columns
    assert "CASE WHEN" not in [line for line in items._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line][0]
    held.pop().unpersist()


def test_all_runs_are_logged(spark, tmp_path):
    """Good, busy, failed and degraded runs, with what they counted while they wrote."""
    store, log = state.Store(spark, f"file://{tmp_path}/state"), f"{tmp_path}/log"
    landed = Landed(pages(spark, (0, 0, 200, [card(1), card(2)])))
    go = lambda n, store, run=SPEC, landed=landed: run_and_commit(
        run, landed, f"2024-01-0{n}T00:00:00.000Z", store, "k", "f", f"r{n}", f"{tmp_path}/out{n}", log=log)
    go(3, store)
    go(4, store)
    assert state.acquire(store, "k", "other") == (True, "ok")
    go(5, store)
    with pytest.raises(RunFailed):
        go(5, Unopened("HTTP status 503"))
    go(5, Unopened("HTTP status 503"), replace(SPEC, allowNonIncrementalFallback=True))
    found = [(r.day, r.run_id, r.status, r.kind, r.coverage_reason, r.emitted, r.skipped, r.new, r.unchanged) for r in runs.read(spark, log).orderBy("day", "status").collect()]
    assert found == [
        ("2024-01-03", "r3", "ok", None, "no_prior_state", 2, 0, 2, None), ("2024-01-04", "r4", "ok", None, None, 2, 0, None, 2),
        ("2024-01-05", "r5", "busy", "conflict", None, None, None, None, None), ("2024-01-05", "r5", "degraded", "platform", None, 2, 0, None, None),
        ("2024-01-05", "r5", "failed", "platform", None, None, None, None, None)]
    days = {r.day: (r.runs, r.ok, r.success_share, r.failures, r.emitted) for r in runs.by_day(runs.read(spark, log)).collect()}
    assert days == {"2024-01-03": (1, 1, 1.0, "", 2), "2024-01-04": (1, 1, 1.0, "", 2), "2024-01-05": (3, 0, 0.0, "platform=1", 2)}


def test_pages_of_other_origin_are_held_to_the_spec(spark):
    """The newest day comes first, then the order of the scan; what is too old or of another region goes."""
    def dated(i, day, place="Berlin, Germany"):
        return card(i).replace("2024-01-02", day).replace("Berlin, Germany", place)

    landed = pages(spark, (0, 0, 200, [dated(1, "2024-01-01"), dated(2, "2024-01-05"), dated(3, "2023-11-01")]),
                   (1, 0, 200, [dated(4, "2024-01-05"), dated(5, "2024-01-05", "Paris, France"), dated(6, "2024-01-05", "Nowhere")]))
    run = spec.RunSpec.from_dict({"keywords": "x", "datePosted": "last30d", "regions": ["DE"], "maxResults": 0})
    for incremental in (False, True):
        own = Landed(landed, own=False)
        result = run_incremental(run, own, "2024-01-10T00:00:00.000Z", C.empty_state(spark), C.Coverage(True)) if incremental else run_once(run, own, "2024-01-10T00:00:00.000Z")
        assert [(r.emit_order, r.sourceJobId) for r in result.rows.orderBy("emit_order").collect()] == [(0, "2"), (1, "4"), (2, "6"), (3, "1")]
        result.release()
    relevant = spec.RunSpec.from_dict({"keywords": "x", "sortBy": "relevant", "maxResults": 2})
    result = run_once(relevant, Landed(landed, own=False), "2024-01-10T00:00:00.000Z")
    assert [r.sourceJobId for r in result.rows.orderBy("emit_order").collect()] == ["1", "2"]
    result.release()


class Unopened:
    """A store that can't be read."""

    def __init__(self, message):
        self.message = message

    def write(self, *args, **kwargs):
        raise OSError(self.message)

    names = read = write


def test_a_state_that_cannot_be_opened(spark, tmp_path):
    landed = Landed(pages(spark, (0, 0, 200, [card(1)])))
    for message, kind in (("403 forbidden", "permission"), ("HTTP status 503", "platform"), ("disk", "other")):
        with pytest.raises(RunFailed) as failure:
            run_and_commit(SPEC, landed, "2024-01-03T00:00:00.000Z", Unopened(message), "k", "f", "r", f"{tmp_path}/no")
        assert failure.value.kind == kind
    may = spec.RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "allowNonIncrementalFallback": True})
    done = run_and_commit(may, landed, "2024-01-03T00:00:00.000Z", Unopened("disk"), "k", "f", "r", f"{tmp_path}/yes")
    assert (done["status"], done["reason"], done["summary"]["emitted"]) == ("degraded", "other", 1)
    decisions = {("opened", False): "proceed", ("lock_busy", False): "exit", ("unavailable", True): "degrade", ("unavailable", False): "fail"}
    assert all(state.open_decision(kind, allowed) == action for (kind, allowed), action in decisions.items())
    assert state.open_decision("unavailable", canary=True) == "degrade"


def test_related_pages_of_the_first_seeds(spark):
    landed = pages(spark, (0, 0, 200, [card(1), card(2), card(3)]))
    related = spark.createDataFrame([("3", card(30)), ("2", card(20) + card(1)), ("1", card(10))], landing.RELATED_SCHEMA)
    ids = lambda seeds: [r.sourceJobId for r in landing.scan_cards(landed, 0, related, seeds).orderBy("scan_ordinal").collect()]
    assert ids(0) == ["1", "2", "3"] and ids(2) == ["1", "2", "3", "10", "20"] and ids(9) == ["1", "2", "3", "10", "20", "30"]
    run = spec.RunSpec.from_dict({"keywords": "x", "discoverRelated": True, "relatedSeedCount": 1})
    rows = run_once(run, Landed(landed, related=related), "2024-01-03T00:00:00.000Z").rows
    assert sorted(r.sourceJobId for r in rows.collect()) == ["1", "10", "2", "3"]


def test_secrets_are_hidden():
    secret = {"jwt": "a", "sessionState": "b", "storageState": {"c": 1}, "authCookie": "d", "api_key": "e", "whatsappAccessToken": "f", "slackWebhookUrl": "g"}
    assert set(spec.redacted(secret).values()) == {"[redacted]"} and spec.redacted({"title": "x"}) == {"title": "x"}


def test_nothing_is_exported_twice(spark, tmp_path):
    store, calls = state.Store(spark, f"file://{tmp_path}/state"), []
    records = [{"jobId": "j", "title": "T", "salaryMin": 5, "other": "x"}]
    send = lambda: sinks.export_once(store, "export", records, ["append_row"], lambda t, a: calls.append(a), "jobs", now="2024-01-03")
    failed = sinks.export_once(store, "export", records, ["append_row"], lambda t, a: {"isError": True}, "jobs", now="2024-01-03")
    assert failed["errors"] == 1 and send()["exported"] == 1 and send()["target"] == "done"
    assert calls == [{"row": {"Job id": "j", "Title": "T", "Salary min": "5"}}]


def test_a_baseline_comes_back_to_its_own_source(spark):
    census = spark.createDataFrame([("apiJob", "title", 3), ("apiJob", "new", 1)], "layer string, field string, sample_count long")
    none = spark.createDataFrame([], S.BASELINE_FIELDS)
    mapped, ignored = S.layer_fields(spark, {"apiJob": ("title",)}), S.layer_fields(spark, {"apiJob": ()})
    kept = S.stored_baseline(S.schema_drift(census, none, mapped, ignored, "2024-01-01"), "feeds")
    assert kept.schema == spark.createDataFrame([], S.BASELINE_SCHEMA).schema or set(kept.columns) == {p.split()[0] for p in S.BASELINE_SCHEMA.split(", ")}
    assert S.adopted_baseline(kept, "others").count() == 0 and S.adopted_baseline(kept, "feeds", "test").count() == 0
    again = S.schema_drift(census.where("field = 'title'"), S.adopted_baseline(kept, "feeds"), mapped, ignored, "2024-01-02")
    found = {r.field: (r.first_seen_at, r.sample_count, r.disappeared) for r in again.collect()}
    assert found == {"title": ("2024-01-01", 6, False), "new": ("2024-01-01", 1, True)}


def test_coverage_reasons_agree(spark):
    flags = [(a, b, n, d, k) for a in (True, False) for b in (True, False) for n in (0, 2) for d in (True, False) for k in (True, False)]
    rows = spark.createDataFrame(flags, "a boolean, b boolean, n int, d boolean, k boolean")
    for r in rows.withColumn("reason", C.incomplete_because(F.col("a"), F.col("b"), F.col("n"), F.col("d"), F.col("k"))).collect():
        found = C.Coverage(True).after_scan(capped=r.a, page_cap=r.b, failed_pages=r.n, degraded=r.d, pagination_known=r.k)
        assert (found.reason, found.complete) == (r.reason, r.reason is None)
