import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import conversation, safety, tables
from plumbline.plans import monitoring
from plumbline.sources import artifacts, documents, files
from plumbline.streaming import jobs
from plumbline.streaming import metrics as sm

catalog.load()


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


# ---------------------------------------------------------------- files

def test_csv_upload(spark, tmp_path):
    df = files.read_table(spark, put(tmp_path / "up.csv", "col1,col2\n1,2\n3,4\n"))
    assert df.dtypes == [("col1", "bigint"), ("col2", "bigint")] and df.count() == 2


def test_census_file_without_header(spark, tmp_path):
    text = "39, State-gov, 77516, <=50K\n50, ?, 83311, >50K\n"
    df = files.read_table(spark, put(tmp_path / "adult.data", text), names=["age", "workclass", "fnlwgt", "income"])
    assert [tuple(r) for r in df.collect()] == [(39, "State-gov", 77516, "<=50K"), (50, None, 83311, ">50K")]
    header = files.read_table(spark, put(tmp_path / "adult.csv", text))
    assert header.count() == 1  # the first row is taken as header


def test_csv_skips_long_lines_and_keeps_short_ones(spark, tmp_path):
    text = "a;b;c\n1;x;2.5\n2;y;3;4\n3; z \n4;NaN;null\n"
    rows = files.read_table(spark, put(tmp_path / "s.csv", text)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (3, "z", None), (4, None, None)]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = put(tmp_path / "d.csv", f"a{sep}b\n1{sep}x y\n")
    assert files.guess_delimiter(spark, path) == sep


def test_json_layouts_and_unknown_suffix(spark, tmp_path):
    lines = files.read_table(spark, put(tmp_path / "l.json", '{"a": 1}\n{"a": 2}\n'))
    array = files.read_table(spark, put(tmp_path / "r.json", '[\n{"a": 1},\n{"a": 2}]'))
    columns = files.read_json(spark, put(tmp_path / "c.json", '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": null}}'), orient="columns")
    assert sorted(r.a for r in lines.collect()) == sorted(r.a for r in array.collect()) == [1, 2]
    assert sorted(tuple(r) for r in columns.fillna("").collect()) == [(1, "x"), (2, "")]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xyz")


def test_document_folder(spark, tmp_path):
    put(tmp_path / "a" / "one.txt", "plain text")
    put(tmp_path / "a" / "b" / "two.MD", "# Title **x**")
    put(tmp_path / "three.html", "<title>T</title><p>hi</p>")
    put(tmp_path / "skip.bin", "no")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.txt", "two.MD", "three.html", "bad.txt"}
    assert got["two.MD"].text == "Title x" and got["three.html"].title == "T" and got["bad.txt"].text == "ok � end"
    assert got["one.txt"].file_size_bytes == 10
    report = {r.file_type: r.files for r in documents.discovery_report(documents.discover(spark, str(tmp_path))).collect()}
    assert report == {".txt": 2, ".md": 1, ".html": 1}
    documents.register_loader(".BIN", lambda c: documents._struct(F.upper(c)))
    try:
        assert documents.load_documents(spark, str(tmp_path), [".bin"]).first().text == "NO"
    finally:
        del documents.LOADERS[".bin"]
    with pytest.raises(ValueError):
        documents.load_documents(spark, str(tmp_path), [".pdf"])


def test_saved_params(spark, tmp_path):
    params = spark.createDataFrame([("x", 1.5)], "column_name string, center double")
    for run, day in (("r1", "2024-01-01"), ("r2", "2024-01-02")):
        artifacts.save_params(params, str(tmp_path / "p"), "d1", run, day)
    assert [r.run_id for r in artifacts.list_runs(spark, str(tmp_path / "p"), "d1").collect()] == ["r2", "r1"]
    back = artifacts.load_params(spark, str(tmp_path / "p"), "d1", "r1", "column_name string, center double")
    assert [tuple(r) for r in back.collect()] == [("x", 1.5)]


# ---------------------------------------------------------------- tables and conversations

def test_stage_transition(spark):
    registry = spark.createDataFrame([("m", 1, "Production"), ("m", 2, "Staging"), ("n", 1, "Production")], "name string, version int, stage string")
    moves = spark.createDataFrame([("m", 2, "Production")], "name string, version int, stage string")
    def after(**kw):
        return sorted(tuple(r) for r in tables.transition_stage(registry, moves, **kw).collect())
    assert after() == [("m", 1, "Archived"), ("m", 2, "Production"), ("n", 1, "Production")]
    assert after(archive_existing=False) == [("m", 1, "Production"), ("m", 2, "Production"), ("n", 1, "Production")]


def test_resolution_order(spark):
    registry = spark.createDataFrame([("m", 1, "Production"), ("m", 5, "None"), ("n", 3, "None")], "name string, version int, stage string")
    asked = spark.createDataFrame([("m", None), ("m", 5), ("n", None), ("q", None)], "name string, version int")
    got = [tuple(r) for r in tables.resolve_versions(asked, registry).collect()]
    assert sorted(got, key=str) == sorted([("m", None, 1), ("m", 5, 5), ("n", None, 3), ("q", None, None)], key=str)


def test_rollback_to_a_version_that_exists(spark):
    current = spark.createDataFrame([(1, 3, "c3"), (2, 1, "d1")], "dataset_id int, version int, checksum string")
    versions = spark.createDataFrame([(1, 1, "c1"), (1, 3, "c3"), (2, 1, "d1")], "dataset_id int, version int, checksum string")
    choice = spark.createDataFrame([(1, 1), (2, 9)], "dataset_id int, version int")
    assert sorted(tuple(r) for r in tables.rollback(current, versions, choice, ["checksum"]).collect()) == [(1, 1, "c1"), (2, 1, "d1")]


def test_nested_pages_split_a_hot_parent(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    steps = spark.createDataFrame([(1, i, f"s{i}") for i in range(25)] + [(2, 0, "only")], "run int, step int, name string")
    got = {(r.run, r.page): [x.name for x in r["items"]] if r["items"] else None
           for r in tables.nested_pages(parents, steps, "run", ["step"], ["name"], size=10).collect()}
    assert got == {(1, 0): [f"s{i}" for i in range(10)], (1, 1): [f"s{i}" for i in range(10, 20)], (1, 2): [f"s{i}" for i in range(20, 25)],
                   (2, 0): ["only"], (3, None): None}


def test_history_and_messages(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "conv string, turn int, role string, text string")
    kept = conversation.history(df, "conv", ["turn"], 5).orderBy("position").collect()
    assert [r.text for r in kept] == [f"m{i}" for i in range(20, 30)] and kept[0].position == 1
    questions = spark.createDataFrame([("c", "now?", "ctx " * 3000), ("d", "new?", "  ")], "conv string, question string, context string")
    built = conversation.build_messages(questions, conversation.history(df, "conv", ["turn"], 1), "conv", "SYS", "RULES", "KB")
    got = {r.conv: [(m.role, m.content) for m in r.messages] for r in built.collect()}
    assert [r for r, _ in got["c"]] == ["system", "system", "user", "assistant", "user"]
    assert got["c"][0][1] == "SYS\n\nKnowledge Base: KB" and got["c"][-1][1] == "now?"
    assert len(got["c"][1][1]) == len("RULES\n\n--- BEGIN CONTEXT ---\n\n--- END CONTEXT ---") + 6000
    assert conversation.NO_CONTEXT in got["d"][1][1] and len(got["d"]) == 3
    assert len(conversation.fallback_messages(questions, "SYS").first().messages) == 3


def test_sessions_of_a_busy_user(spark):
    start = datetime.datetime(2024, 1, 1)
    minutes = [("hot", m) for m in range(0, 600)] + [("hot", 700), ("cold", 0), ("cold", 30), ("cold", 61)]
    df = spark.createDataFrame([(u, start + datetime.timedelta(minutes=m)) for u, m in minutes], "u string, ts timestamp_ntz")
    got = sorted((r.u, r.events) for r in sm.sessions(df, "u", "ts", 30 * 60).collect())
    assert got == [("cold", 1), ("cold", 2), ("hot", 1), ("hot", 600)]


# ---------------------------------------------------------------- streams

@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The events table as several files in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartitionByRange(5, "ts").write.mode("overwrite").parquet(folder)
    return folder, events


def test_stream_equals_batch_file_by_file(spark, parts):
    folder, events = parts
    stream = jobs.file_stream(spark, folder, events.schema, files=1)
    got = jobs.run_to_table(sm.mean_values(stream, "ts", "value", ["event_type"], "1 day", late="40 days"), "m").collect()
    assert got == []  # nothing has passed so late a watermark
    stream = jobs.file_stream(spark, folder, events.schema, files=5)
    got = {(r.window_start, r.event_type): (round(r.mean_value, 9), r.samples) for r in
           jobs.run_to_table(sm.mean_values(stream, "ts", "value", ["event_type"], "1 day"), "m").collect()}
    batch = {(r.window_start, r.event_type): (round(r.mean_value, 9), r.samples) for r in
             sm.mean_values(events, "ts", "value", ["event_type"], "1 day").collect()}
    last = max(w for w, _ in batch)
    assert got == {k: v for k, v in batch.items() if k[0] < last}


def test_stateless_streams_equal_batches(spark, parts):
    folder, events = parts
    stream = jobs.file_stream(spark, folder, events.schema, files=1)
    checked = safety.check_text(stream.select("event_id", F.col("props").alias("text")))
    got = jobs.run_to_table(checked, "safe")
    want = safety.check_text(events.select("event_id", F.col("props").alias("text")))
    assert sorted(got.collect()) == sorted(want.collect(), key=lambda r: r.event_id) or got.exceptAll(want).count() == 0


def test_uploads_are_dropped_across_batches(spark, parts):
    folder, events = parts
    stream = jobs.file_stream(spark, folder, events.schema, files=1).select("ts", "event_type")
    got = jobs.run_to_table(jobs.distinct_uploads(stream, "ts", ["event_type"], "60 days"), "u")
    assert got.count() == events.select("event_type").distinct().count()


def test_stream_drift_matches_the_batch(spark, parts, tmp_path):
    folder, events = parts
    first = tables.in_window(events, "ts", "2024-01-01", "2024-01-08")
    snapshot = monitoring.baseline_snapshot(first, ["value"])
    path = str(tmp_path / "reports")
    jobs.drift_stream(jobs.file_stream(spark, folder, events.schema, files=5), "ts", ["value"], snapshot, "7 days", path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) >= 3
    for r in rows:
        now = tables.in_window(events, "ts", r.window_start, r.window_end)
        direct = monitoring.drift_against_snapshot(snapshot, now, ["value"]).first()
        assert r.psi == pytest.approx(direct.psi) and r.js_distance == pytest.approx(direct.js_distance)


def test_failed_events_keep_their_reason_and_replays_change_nothing(spark, parts, tmp_path):
    folder, events = parts
    path, seen = str(tmp_path / "handled"), []

    def welcome(rows, number):
        seen.append(number)
        rows.write.mode("overwrite").parquet(f"{path}/welcome/batch={number}")

    def receipt(rows, number):
        rows.select(F.raise_error(F.concat(F.lit("no printer for "), "event_type"))).collect()

    handlers, routes = {"welcome": welcome, "receipt": receipt}, {"signup": "welcome", "purchase": "receipt", "error": "nobody"}
    columns = ["event_id", "event_type"]
    one = tmp_path / "in"
    events.where("event_id % 2 = 0").select(columns).write.parquet(str(one / "a"))
    schema = events.select(columns).schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(one))
        jobs.routing_job(stream, handlers, path, routes)

    def state():
        return sorted(((r.event_id, r.event_type, r.target, r.status, "no printer for purchase" in (r.error or "")) for r in jobs.handled_events(spark, path).collect()))

    def wanted(rows):
        return sorted((r.event_id, r.event_type, routes.get(r.event_type), "failed" if r.event_type == "purchase" else "processed", r.event_type == "purchase") for r in rows.collect())

    run()
    assert state() == wanted(events.where("event_id % 2 = 0")) and seen == [0]
    events.where("event_id % 2 = 1").select(columns).write.parquet(str(one / "b"))
    run()
    assert state() == wanted(events) and seen == [0, 1]
    jobs.handle_events(events.where("event_id % 2 = 1").select(columns), 1, handlers, path, routes)  # the batch comes again
    assert state() == wanted(events)
    assert jobs.handled_events(spark, path, "failed").count() == events.where("event_type = 'purchase'").count()
    assert spark.read.parquet(f"{path}/welcome").count() == events.where("event_type = 'signup'").count()


def test_streamed_table_may_be_a_folder_of_files(spark, small, tmp_path):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert catalog.QUERIES["stream_safety"](spark, str(tmp_path)).count() == turns.count() > 0


def test_written_documents_come_back_whole(spark, tmp_path):
    rows = [(g, f"{t} {n}") for n, (g, t) in enumerate([(None, "no group"), ("", "empty"), ("_x", "two\nlines\r"), ("a/b", "é ß"), (".h", "last")] * 90)]
    df = spark.createDataFrame([*rows, ("a/b", None), ("a/b", "")], "source string, text string").repartition(3)
    assert documents.write_documents(df, str(tmp_path / "out"), "source") == 451
    loaded = documents.load_documents(spark, str(tmp_path / "out"), [".txt"])
    assert sorted(r.text for r in loaded.collect()) == sorted([t + "\n" for _, t in rows] + ["\n"])
    assert documents.discovery_report(documents.discover(spark, str(tmp_path / "out"))).first().files == 451


def test_folders_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    top = tmp_path / "a b%20c"
    for n, name in enumerate(("x.txt", "_hid.txt", ".dot.txt", "_a=b.txt", "sub/y.TXT", "_sub/z.txt", "k=v/q \u00e9.txt", "u.txt._COPYING_",
                              "s#p?.txt", "1/2/3/4/5/deep.txt", "1/2/.3/no.txt", "1/skip.bin", "_metadata.txt", "1/two.md")):
        put(top / name, f"text {n}\r\n")
    put(top / "empty.txt", "")
    (top / "link").symlink_to(top / "sub")

    def by_spark(folder):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select("path", "length", "content").collect()
        return sorted((r.path, r.length, r.content.decode()) for r in rows if r.path.lower().endswith(".txt"))

    def same():
        monkeypatch.setattr(documents, "CONTENT_BYTES", 10)
        monkeypatch.setattr(documents, "FOLDER_ROWS", 1)
        for folder in (top, top / "x.txt", tmp_path / "a*", top / "{1,1/2,k=v}", top.as_uri()):
            folder = str(folder) if "file:" not in str(folder) else f"file:{top}"
            wanted = by_spark(folder)
            assert len(wanted) >= 1
            assert sorted((r.path, r.file_size_bytes) for r in documents.discover(spark, folder, [".txt"]).collect()) == [w[:2] for w in wanted]
            assert sorted((r.path, r.file_size_bytes, r.text) for r in documents.load_documents(spark, folder, [".txt"]).collect()) == wanted
        with pytest.raises(AnalysisException):
            documents.discover(spark, str(tmp_path / "none")).count()
        (tmp_path / "no files" / "below").mkdir(parents=True, exist_ok=True)
        assert documents.discover(spark, str(tmp_path / "no files")).count() == documents.load_documents(spark, str(tmp_path / "no files")).count() == 0

    same()
    # the driver's reader of files isn't asked
    plan = documents.load_documents(spark, str(top), [".txt"])._jdf.queryExecution().toString()
    assert "binaryFile" not in plan
    with monkeypatch.context() as only_spark:
        only_spark.setattr(documents._Folder, "open", lambda spark, folder: None)
        same()
