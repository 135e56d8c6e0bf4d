"""Streams with state against the same answers for tables; restarts, late rows, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import linkage, processing, suggestions
from quillspark.streaming import processors, rescoring

START = dt.datetime(2026, 1, 1)


def fed(spark, tmp_path, name, batches, schema, make, **options):
    """Runs a stream over the batches, one after the other, each through a query that starts from the last one's checkpoint; all rows it wrote, by batch."""
    source, out = tmp_path / f"{name}-in", []
    source.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(source))
        got = []
        query = make(stream).writeStream.outputMode(options.get("mode", "append")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True)
        query.foreachBatch(lambda df, _, got=got: got.extend(df.collect())).start().awaitTermination()
        out.append(got)
    return out


def step_rows(rng, n):
    rows, seq = [], 0
    for i in range(n):
        doc = f"d{rng.randint(0, 11)}"
        at = START + dt.timedelta(seconds=rng.randint(0, 50) if i % 3 else 25)
        if rng.random() < 0.15:
            rows.append((doc, seq, at, None, "planned", None, rng.sample(processing.STEPS, rng.randint(0, 9))))
        else:
            kind = rng.choice(["started", "started", "succeeded", "succeeded", "succeeded", "skipped", "failed", "queued"])
            rows.append((doc, seq, at, rng.choice(processing.STEPS), kind, f"e{seq}" if kind == "failed" else None, None))
        seq += 1
    return rows


EVENT = "document_id string, seq long, at timestamp, step string, kind string, error string, steps array<string>"


def test_step_machine_equals_the_fold_after_every_batch(spark, tmp_path):
    """Events come in any order, over restarts of the query."""
    rows = step_rows(random.Random(2), 240)
    random.Random(3).shuffle(rows)
    batches = [rows[:80], rows[80:81], rows[81:240]]
    out = fed(spark, tmp_path, "steps", batches, EVENT, lambda s: processors.step_stream(s, late=None), mode="update")
    stands, seen = {}, []
    for got, batch in zip(out, batches, strict=True):
        seen += batch
        stands |= {r.document_id: tuple(r) for r in got}
        want = processing.fold_step_events(spark.createDataFrame(seen, EVENT)).select("document_id", "status", "next_step", "done", "attempts", "error").collect()
        assert stands == {r.document_id: tuple(r) for r in want}
        assert {r.document_id for r in got} == {r[0] for r in batch}


def test_step_status_by_hand():
    rows = [(0, "inspect", "succeeded", None, 1), (3, "pdf-text", "failed", "late", 2), (1, "text", "failed", "early", 1)]
    assert processing.step_status(rows) == ("failed", "text", 1, 4, "early")
    assert processing.step_status([]) == ("ready", None, 0, 0, None)


def test_ready_documents_are_forgotten(spark, tmp_path):
    done = [("a", i, START, s, "succeeded", None, None) for i, s in enumerate(processing.STEPS)]
    other = [("b", 50, START + dt.timedelta(hours=40), "text", "started", None, None)]
    again = [("a", 99, START + dt.timedelta(hours=41), "text", "started", None, None)]
    out = fed(spark, tmp_path, "forget", [done, other, other, again], EVENT, lambda s: processors.step_stream(s, forget_s=3600), mode="update")
    assert [(r.document_id, r.status) for r in out[0]] == [("a", "ready")]
    assert [(r.document_id, r.status, r.done) for r in out[3] if r.document_id == "a"] == [("a", "processing", 0)]


def greedy(rows, most, window_s):
    """By hand: an attempt passes if fewer than ``most`` passed in the window before it."""
    held, out = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        passed = [t for t in held.get(key, []) if (at - t).total_seconds() < window_s]
        if len(passed) < most:
            held[key] = [*passed, at]
            out[i] = (True, None)
        else:
            ms = round((passed[0] - at).total_seconds() * 1000) + window_s * 1000
            out[i] = (False, -(-ms // 1000))
    return out


def attempts(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aab"), i, START + dt.timedelta(milliseconds=rng.choice([1, 250, 1000]) * rng.randint(0, 900))) for i in range(n)]


def test_limits_on_a_table(spark):
    rows = [*attempts(300, 1), ("c", 900, START), ("c", 901, START + dt.timedelta(seconds=10)), ("c", 902, START + dt.timedelta(seconds=20))]
    df = spark.createDataFrame(rows, "key string, id long, at timestamp").repartition(3)
    for most, window in ((3, 10), (1, 60), (5, 100)):
        got = {r.id: (r.passed, r.retry_after_s) for r in processors.limited(df, most=most, window_s=window).collect()}
        assert got == greedy(rows, most, window) and len({x[0] for x in got.values()}) == 2
    assert processors.limited(df.limit(0)).collect() == []


def test_limits_on_a_stream_equal_those_on_a_table(spark, tmp_path):
    rows = sorted(attempts(200, 2), key=lambda r: (r[2], r[1]))
    batches = [rows[:90], rows[90:91], rows[91:]]
    out = fed(spark, tmp_path, "limits", batches, "key string, id long, at timestamp", lambda s: processors.limited_stream(s, most=3, window_s=10, late="1 hour"))
    assert {r.id: (r.passed, r.retry_after_s) for got in out for r in got} == greedy(rows, 3, 10)


def test_limits_hold_no_more_than_they_need(spark, tmp_path):
    """No more times than may pass; none once the window is over."""
    hot = [("k", i, START + dt.timedelta(milliseconds=i)) for i in range(500)]
    later = [("z", 1000, START + dt.timedelta(hours=2)), ("z", 1001, START + dt.timedelta(hours=3))]
    path = str(tmp_path / "held-state")
    make = lambda s: processors.limited_stream(s, most=4, window_s=60)
    fed(spark, tmp_path, "held", [hot], "key string, id long, at timestamp", make)
    state = lambda: spark.read.format("statestore").option("path", path).option("stateVarName", "recent").load()
    held = state().filter("key.key = 'k'").collect()
    assert len(held) <= 4
    fed(spark, tmp_path, "held", [later[:1], later[1:], [("z", 1002, START + dt.timedelta(hours=4))]], "key string, id long, at timestamp", make)
    assert state().filter("key.key = 'k'").count() == 0


def test_files_are_given_once_they_are_stable(spark, tmp_path):
    t = lambda s: START + dt.timedelta(seconds=s)
    scan = lambda s, *files: [(p, size, START, t(s)) for p, size in files]
    batches = [scan(0, ("a", 1), ("b", 1)), scan(10, ("a", 1), ("b", 2)), scan(20, ("a", 1), ("b", 2)), scan(30, ("b", 2)), scan(40, ("b", 2)), scan(50, ("b", 2)), scan(60, ("a", 1), ("b", 2)), scan(70, ("a", 1), ("b", 3)), scan(80, ("a", 1), ("b", 3))]
    out = fed(spark, tmp_path, "files", batches, "path string, size long, mtime timestamp, seen_at timestamp", lambda s: processors.stable_stream(s, stable_s=10, scan_s=10))
    assert [[(r.path, r.size) for r in got] for got in out] == [[], [("a", 1)], [("b", 2)], [], [], [], [], [("a", 1)], [("b", 3)]]


CANDIDATE = "id string, user_id string, folder_id string, created_at timestamp, original_filename string, mime_type string, document_date date, vendor string, text_head string, text_tail string, mean_embedding array<float>"


@pytest.fixture
def scans(spark):
    rows = [(f"{u}{i}", u, None, START + dt.timedelta(seconds=20 * i), f"{u}_{i}.png", "image/png", None, None, f"Page {i} of 3", None, None) for u in "uv" for i in (1, 2, 3)]
    return spark.createDataFrame(rows, CANDIDATE)


def test_rescoring_writes_each_version_once(spark, scans, tmp_path):
    table = rescoring.VersionedTable(spark, f"file://{tmp_path}/suggestions", rescoring.SUGGESTIONS)
    settled = [("v1,v2,v3", "v", ["v1", "v2", "v3"], 0.1, "low", "dismissed"), ("gone", "u", ["x", "y"], 0.9, "high", "open"), ("w", "w", ["p", "q"], 0.9, "high", "open")]
    table.write(-1, lambda _: spark.createDataFrame(settled, rescoring.SUGGESTIONS))
    source = tmp_path / "uploads"
    source.mkdir()

    def run(rows, calls, crash=False):
        spark.createDataFrame(rows, "user_id string, at timestamp").coalesce(1).write.mode("append").parquet(str(source))

        def candidates():
            calls.append(1)
            if crash:
                raise RuntimeError("stopped in mid batch")
            return scans

        stream = spark.readStream.schema("user_id string, at timestamp").parquet(str(source))
        query = rescoring.rescore_on_quiet(stream, table, candidates, quiet_s=60).option("checkpointLocation", str(tmp_path / "rescore-state")).trigger(availableNow=True)
        query.start().awaitTermination()

    calls, at = [], lambda m: START + dt.timedelta(minutes=m)
    run([("u", at(0)), ("u", at(0.5)), ("v", at(0))], calls)
    before = {tuple(map(str, r)) for r in table.read().collect()}
    with pytest.raises(Exception, match="mid batch"):
        run([("w", at(30))], calls, crash=True)
    assert {tuple(map(str, r)) for r in table.read().collect()} == before
    run([("x", at(60))], calls)
    rows = {r.member_key: r for r in table.read().collect()}
    # w fell quiet too, and nothing of w's is a group any more
    assert set(rows) == {"u1,u2,u3", "v1,v2,v3"}
    assert rows["u1,u2,u3"].status == "open" and rows["u1,u2,u3"].document_ids == ["u1", "u2", "u3"] and rows["v1,v2,v3"].status == "dismissed"
    last = table.versions()[-1]
    assert not table.write(last, lambda _: 1 / 0)


def test_rescoring_leaves_other_users_alone(spark, scans):
    stored = spark.createDataFrame([("k", "v", ["a", "b"], 0.7, "medium", "open")], rescoring.SUGGESTIONS)
    users = spark.createDataFrame([("u",)], "user_id string")
    after = {r.member_key: r.user_id for r in rescoring.rescored(stored, scans, users).collect()}
    assert after == {"k": "v", "u1,u2,u3": "u"}
    groups = linkage.merge_groups(scans)
    assert sorted(r.k for r in groups.select(suggestions.member_key(F.col("document_ids")).alias("k")).collect()) == ["u1,u2,u3", "v1,v2,v3"]


def test_an_import_tells_where_it_stands(spark, tmp_path):
    import time

    from quillspark.streaming.archive import ImportProgress, observed_import

    source = tmp_path / "entries"
    listener = ImportProgress()
    spark.streams.addListener(listener)
    try:
        for i, actions in enumerate((["imported", "imported", "failed"], ["skipped", "imported"])):
            spark.createDataFrame([(a,) for a in actions], "action string").coalesce(1).write.mode("append").parquet(str(source))
            if i == 0:
                stream = spark.readStream.schema("action string").parquet(str(source))
                query = observed_import(stream, "j1").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "import-state")).start()
            query.processAllAvailable()
            until = time.time() + 20
            while listener.of("j1")["seen"] < (3, 5)[i] and time.time() < until:
                time.sleep(0.2)
            assert listener.of("j1") == ({"seen": 3, "imported": 2, "skipped": 0, "failed": 1, "finished": False}, {"seen": 5, "imported": 3, "skipped": 1, "failed": 1, "finished": False})[i]
        query.stop()
        until = time.time() + 20
        while not listener.of("j1")["finished"] and time.time() < until:
            time.sleep(0.2)
        assert listener.of("j1")["finished"] and listener.of("other")["seen"] == 0
    finally:
        spark.streams.removeListener(listener)


def test_steps_run_in_order_and_pick_up_what_failed(spark):
    docs = spark.createDataFrame([("a", "text/plain", "one", None), ("b", "text/plain", "bad", None), ("c", "image/png", None, None), ("d", "text/plain", "two", "kept")], "id string, mime string, body string, text string")
    runs = []

    def text(df):
        runs.append("text")
        return df.withColumn("error", F.when(F.col("body") == "bad", "unreadable")).withColumn("text", F.upper("body"))

    steps = [
        processing.Step("inspect", lambda: F.lit(True), lambda df: df.withColumn("body", F.trim("body"))),
        processing.Step("text", lambda: F.col("mime") == "text/plain", text, extracts_text=True),
        processing.Step("index", lambda: F.col("text").isNotNull(), lambda df: df.withColumn("body", F.concat("text", F.lit("!")))),
    ]
    after, outcomes = processing.run_steps(docs, steps, merged=F.col("id") == "d")
    assert sorted(tuple(r) for r in after.collect()) == [("a", "text/plain", "ONE!", "ONE"), ("b", "text/plain", "bad", None), ("c", "image/png", None, None), ("d", "text/plain", "kept!", "kept")]
    told = {(r.document_id, r.step): (r.status, r.error) for r in outcomes.collect()}
    assert told[("a", "text")] == ("succeeded", None) and told[("b", "text")] == ("failed", "unreadable") and ("b", "index") not in told
    assert told[("c", "text")] == ("skipped", None) == told[("c", "index")] and told[("d", "text")] == ("skipped", None) and told[("d", "index")] == ("succeeded", None)
    mended = after.withColumn("body", F.when(F.col("id") == "b", "good").otherwise(F.col("body")))
    again, more = processing.run_steps(mended, steps, done=outcomes)
    assert sorted((r.document_id, r.step, r.status) for r in more.collect()) == [("b", "index", "succeeded"), ("b", "text", "succeeded")]
    assert {r.id: r.text for r in again.collect()}["b"] == "GOOD"


def test_of_events_with_one_time_and_number_the_first_counts(spark, tmp_path):
    rows = [("d", 5, START, "text", "succeeded", None, None), ("d", 5, START, "text", "failed", "late", None), ("d", 5, START, "text", "started", None, None)]
    for some in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        events = spark.createDataFrame([(*r, i) for i, r in enumerate(some)], f"{EVENT}, place int").repartition(3)
        got = processing.fold_step_events(events, place="place").first()
        first = {"succeeded": "ready", "failed": "failed", "started": "processing"}[some[0][4]]
        assert (got["status"], got["attempts"]) == (first, 1)
    out = fed(spark, tmp_path, "ties", [[r] for r in rows], EVENT, lambda s: processors.step_stream(s, late=None), mode="update")
    assert [r.status for got in out for r in got] == ["ready"] * 3


def test_step_events_of_line_items_that_tie(spark, tmp_path):
    """Two files of lines with one time and number: the first line of the first file counts, whatever it says."""
    from quillspark.plans import catalog

    kinds = {"started": 0, "skipped": 1, "failed": 2, "succeeded": 4}
    status = {"started": "processing", "skipped": "ready", "failed": "failed", "succeeded": "ready"}
    orders = [(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in kinds for b in kinds)]
    line = lambda i, kind: (i, kinds[kind], 0, 2, START)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz"
    for n in range(2):
        spark.createDataFrame([line(i, pair[n]) for i, pair in orders], schema).coalesce(1).write.parquet(str(tmp_path / f"lineitem.parquet/part={n}"))
    got = {r.id: r.status for r in catalog.step_events(spark, str(tmp_path)).collect()}
    assert got == {i: status[pair[0]] for i, pair in orders}


def folded_by_hand(rows):
    """Of rows in their stored order, with a missing time as the greatest."""
    steps, out = {}, {}
    for doc, seq, at, step, kind, error, enabled in rows:
        of = [(n, "queued" if n in (enabled or ()) else "skipped") for n in processing.STEPS] if kind == "planned" else [(step, "running" if kind == "started" else kind)]
        for name, status in of:
            key, old = (at is None, at or START, seq), steps.setdefault(doc, {}).get(name)
            attempts = (old[3] if old else 0) + (status == "running")
            steps[doc][name] = (key, status, error if status == "failed" else None, attempts) if old is None or key > old[0] else (*old[:3], attempts)
    for doc, of in steps.items():
        place = lambda n: processing.STEPS.index(n) if n in processing.STEPS else len(processing.STEPS)
        out[doc] = processing.step_status([(place(n), n, status, error, attempts) for n, (_, status, error, attempts) in of.items()])
    return out


@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz"])
def test_fold_equals_a_fold_by_hand_and_shuffles_once(spark, time):
    """Ties, plans that cross, steps of other names, documents without an id and events without a time; one shuffle, and a plan is one row."""
    rng, rows = random.Random(11), []
    for n in range(1500):
        at = rng.choice([None, *[START + dt.timedelta(days=d, microseconds=d) for d in range(-2, 3)]])
        kind = rng.choice(["planned", "started", "succeeded", "succeeded", "skipped", "failed", "queued"])
        enabled = rng.choice([None, [], rng.sample(processing.STEPS, 4)]) if kind == "planned" else None
        rows.append((rng.choice([None, *[f"d{i}" for i in range(150)]]), rng.randint(-1, 2), at, None if kind == "planned" else rng.choice([*processing.STEPS, "beyond", "aside"]), kind, f"e{n}", enabled))
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{EVENT}, place int").withColumn("at", F.col("at").cast(time))
    got = processing.fold_step_events(events.repartition(3), place="place").select("document_id", "status", "next_step", "done", "attempts", "error")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == folded_by_hand(rows)
    plan = processing.fold_step_events(events, place="place")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_step_events_of_odd_line_items_equal_the_sql(spark, tmp_path):
    """Orders, parts, suppliers, numbers and times that are missing or below nought; no two lines of an order have both time and number in common."""
    duckdb = pytest.importorskip("duckdb")
    from quillspark.plans import catalog

    rng, rows = random.Random(5), {}
    for n in range(3000):
        ids = [None, *range(-3, 400)]
        row = (rng.choice(ids), rng.choice([None, *range(-9, 30)]), rng.choice([None, *range(-12, 30)]), rng.choice([None, *range(-1, 8)]), rng.choice([None, *[START + dt.timedelta(days=d) for d in range(4)]]))
        rows.setdefault((row[0], row[3], row[4]), row)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz"
    spark.createDataFrame(list(rows.values()), schema).repartition(2).write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        want = db.execute(catalog.oracle_sql()["step_events"]).fetchall()
    got = [tuple(r) for r in catalog.step_events(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 350 and set(got) == set(want)


def test_limits_go_by_the_nearest_millisecond(spark, tmp_path):
    """The second attempt rounds up and the third down, so the wait is a whole number of seconds and not a second more or less."""
    at = lambda us: START + dt.timedelta(microseconds=us)
    rows = [("k", 1, at(0)), ("k", 2, at(1_000_400)), ("k", 3, at(1_000_600)), ("m", 1, at(600)), ("m", 2, at(1_000_600)), ("m", 3, at(1_001_499)), ("old", 1, dt.datetime(1969, 12, 31)), ("old", 2, dt.datetime(1969, 12, 31) + dt.timedelta(microseconds=500))]
    schema = "key string, id long, at timestamp"
    got = {(r.key, r.id): r.retry_after_s for r in processors.limited(spark.createDataFrame(rows, schema), most=1, window_s=10).collect()}
    assert got == {("k", 1): None, ("k", 2): 9, ("k", 3): 9, ("m", 1): None, ("m", 2): 9, ("m", 3): 9, ("old", 1): None, ("old", 2): 10}
    one = [("k", 1, at(600)), ("k", 2, at(1_000_499))]  # 1 ms and 1,000 ms: 9.001 s to wait, 10 whole ones; cut off it would be 9
    out = fed(spark, tmp_path, "nearest", [one], schema, lambda s: processors.limited_stream(s, most=1, window_s=10))
    assert [(r.id, r.retry_after_s) for r in out[0]] == [(1, None), (2, 10)]
    table = processors.limited(spark.createDataFrame(one, schema), most=1, window_s=10).orderBy("id").collect()
    assert [r.retry_after_s for r in table] == [None, 10]
