"""Sources and sinks on hand-written fixtures (FIXTURES.md §3)."""

import gzip
import os
import shutil

from pyspark.sql import functions as F

from calltrail.sources import batches as B
from calltrail.sources import logs as L
from calltrail.sources import store as ST


def copy(src_paths, dst):
    os.makedirs(dst, exist_ok=True)
    for p in src_paths:
        shutil.copy(p, dst)
    return dst


def test_batches_v1_v2_lenient_and_bad(spark, fx, tmp_path):
    d = copy([fx("batch_v1.json"), fx("batch_v2.json"), fx("batch_lenient.json"), fx("batch_bad.json"),
              fx("batch_nested.json")], str(tmp_path / "in"))
    ev, rej = B.read_batches(spark, d)
    rows = {r["method"]: r for r in ev.collect()}
    assert set(rows) == {"onCreate", "fetchUser", "add"}
    br = [r for r in ev.collect() if r["type"] == "BRANCH"][0]
    assert br["class_name"] == "MainActivity" and br["file"] == "" and br["line"] == 0
    assert br["condition_result"] is True and br["platform"] is None
    v2 = rows["fetchUser"]
    assert v2["stack"] == ["at f (a.js:1:1)", "at g (b.js:2:2)"] and v2["is_minified"] is True
    assert v2["schema_version"] == 2 and v2["try_start_line"] == 3
    le = rows["add"]
    assert le["ts"] == 5 and le["line"] == 9 and le["thread_id"] == 3
    assert le["params"]["a"] == "2" and le["params"]["flag"] == "true" and le["params"]["b"] == "3.5"
    rj = {os.path.basename(r["batch_id"]): r["reason"] for r in rej.collect()}
    assert rj == {"batch_bad.json": "undecodable event", "batch_nested.json": "undecodable event"}


def test_batch_shape_guards(spark):
    texts = spark.createDataFrame([("a", '{"type":"ENTER"}'), ("b", '[{"type":"ENTER"}] trailing'),
                                   ("c", '[{"type":"ENTER"'), ("d", '[{"type":"ENTER","line":"x"}]'),
                                   ("e", '[{"type":"ENTER","class":null}]'), ("f", '[]'),
                                   ("g", '[{"type":"ENTER","params":{"k":null}}]'),
                                   ("h", '[{"type":"ENTER","stack":["a",{"f":1}]}]'),
                                   ("i", '[{"type":"ENTER","params":{"k":1},"stack":["a","b"]}]')],
                                  "batch_id string, value string")
    ev, rej = B.decode_batches(texts)
    reasons = {r["batch_id"]: r["reason"] for r in rej.collect()}
    assert reasons == {"a": "not a JSON array", "b": "not a JSON array", "c": "not a JSON array",
                       "d": "undecodable event", "e": "undecodable event", "g": "undecodable event",
                       "h": "undecodable event"}
    assert [r["batch_id"] for r in ev.collect()] == ["i"]


def test_raw_bodies_gzip_magic_and_caps(spark, fx, tmp_path):
    d = copy([fx("batch.json.gz"), fx("batch_gz_noext.bin"), fx("batch_v1.json")], str(tmp_path / "raw"))
    with open(os.path.join(d, "oversize.bin"), "wb") as f:
        f.write(b"[" + b" " * (B.MAX_RAW_BYTES - 1) + b"]" + b" ")
    with open(os.path.join(d, "bomb.bin"), "wb") as f:
        f.write(gzip.compress(b"[" + b" " * (B.MAX_INFLATED_BYTES + 10) + b"]"))
    ev, rej = B.read_batches(spark, d)
    per = ev.groupBy(F.element_at(F.split("batch_id", "/"), -1).alias("f")).count().collect()
    assert {r["f"]: r["count"] for r in per} == {"batch.json.gz": 3, "batch_gz_noext.bin": 3, "batch_v1.json": 3}
    reasons = {os.path.basename(r["batch_id"]): r["reason"] for r in rej.collect()}
    assert reasons == {"oversize.bin": "raw body over 5242880 bytes", "bomb.bin": "inflated body over 52428800 bytes"}


def test_logcat_and_report(spark, fx):
    ev, cand = L.read_logcat(spark, fx("logcat.txt"))
    rows = ev.orderBy("seq").collect()
    assert [(r["type"], r["class_name"]) for r in rows] == [("ENTER", "LoginViewModel"), ("EXIT", "LoginViewModel"),
                                                            ("CATCH", "Repo")]
    assert rows[2]["ts"] == 0  # a missing ts is 0, never "now"
    assert rows[0]["params"]["password"] == "***"
    rep = L.load_report(cand).first()
    assert (rep["loaded"], rep["skipped"]) == (3, 3)  # 6 tagged lines, 3 loaded


def test_session_and_detection(spark, fx, tmp_path):
    ev, cand = L.read_session(spark, fx("session.json"))
    rows = ev.orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["ENTER", "EXIT"]
    assert rows[0]["device_manufacturer"] == "" and rows[0]["tag"] == "" and rows[0]["device_model"] == "Pixel 7"
    rep = L.load_report(cand).first()
    assert (rep["loaded"], rep["skipped"]) == (2, 1)
    d = copy([fx("session.json"), fx("logcat.txt")], str(tmp_path / "any"))
    ev2, cand2 = L.read_any(spark, d)
    assert ev2.count() == 5
    kinds = {r["kind"]: (r["loaded"], r["skipped"]) for r in L.load_report(cand2).collect()}
    assert kinds == {"session": (2, 1), "log": (3, 3)}


def test_pages(spark, fx, tmp_path):
    d = copy([fx("page_v1.json"), fx("page_v2.json"), fx("page_other.json")], str(tmp_path / "pages"))
    ev, _ = L.read_pages(spark, d)
    rows = ev.orderBy("ts").collect()
    assert [(r["type"], r["ts"]) for r in rows] == [("ENTER", 10), ("EXIT", 12)]
    assert rows[1]["stack"] == ["x", "y"] and rows[1]["duration_ms"] == 2


def test_store_append_evolve_erase_clear_retention(spark, fx, tmp_path):
    table = str(tmp_path / "store")
    v1, _ = B.read_batches(spark, fx("batch_v1.json"))
    ST.append_events(v1.drop("batch_id", "pos"), table, load_id=1)
    v2, _ = B.read_batches(spark, fx("batch_v2.json"))
    ST.append_events(v2.drop("batch_id", "pos"), table, load_id=2)
    ev = ST.read_events(spark, table)
    assert ev.count() == 4
    seqs = [r["seq"] for r in ev.orderBy("seq").collect()]
    assert len(set(seqs)) == 4 and [q >> 36 for q in seqs] == [1, 1, 1, 2]
    assert sorted({str(r["event_date"]) for r in ev.collect()}) == ["2023-11-14"]
    assert ST.erase_user(spark, table, "u1") == 1
    assert ST.erase_user(spark, table, "u1") == 0
    left = ST.read_events(spark, table)
    assert left.count() == 3 and left.where(F.col("user_id").isNull()).count() == 3
    assert ST.drop_before(spark, table, "2023-11-15") == ["2023-11-14"]
    assert ST.store_count(spark, table) == 0
    ST.append_events(v1.drop("batch_id", "pos"), table, load_id=3)
    assert ST.clear_events(spark, table) == 3
    assert ST.store_count(spark, table) == 0


def test_erase_keeps_other_days(spark, tmp_path):
    table = str(tmp_path / "store2")
    rows = [(i, "ENTER", "C", "m", 86_400_000 * (i % 3), f"u{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, type string, class_name string, method string, ts long, user_id string")
    ST.append_events(df, table, load_id=1)
    assert ST.erase_user(spark, table, "u1") == 6
    ev = ST.read_events(spark, table)
    assert ev.count() == 6 and ev.where(F.col("user_id") == "u1").count() == 0
    assert ev.select("event_date").distinct().count() == 3


def test_session_export_roundtrip(spark, fx, tmp_path):
    ev, _ = L.read_session(spark, fx("session.json"))
    out = str(tmp_path / "export")
    ST.write_session(ev.coalesce(1), out, compat=True)
    back, cand = L.read_session(spark, out)
    rows = back.orderBy("ts").collect()
    assert [r["type"] for r in rows] == ["ENTER", "EXIT"]
    assert rows[0]["params"] == {"param0": "apple"}  # compat keeps only param* keys
    full = str(tmp_path / "full")
    ST.write_session(ev, full)
    assert spark.read.json(full).count() == 2


def test_append_once_is_idempotent(spark, fx, tmp_path):
    table = str(tmp_path / "once")
    v1, _ = B.read_batches(spark, fx("batch_v1.json"))
    ev = v1.drop("batch_id", "pos")
    first = ST.append_events_once(ev, table, load_id=7)
    again = ST.append_events_once(ev, table, load_id=7)   # replay of the same load
    assert first > 0 and again == 0
    back = ST.read_events(spark, table)
    assert back.count() == 3 and back.select("seq").distinct().count() == 3
    ST.append_events_once(ev, table, load_id=8)            # a new load is appended
    assert ST.read_events(spark, table).count() == 6


def test_null_seq_rows_get_ids(spark, fx, tmp_path):
    ev, _ = L.read_logcat(spark, fx("logcat.txt"))
    table = str(tmp_path / "logstore")
    ST.append_events(ev.drop("source").withColumn("seq", F.lit(None).cast("bigint")), table, load_id=5)
    back = ST.read_events(spark, table)
    seqs = [r["seq"] for r in back.collect()]
    assert len(seqs) == 3 and None not in seqs and len(set(seqs)) == 3 and all(s >> 36 == 5 for s in seqs)


def test_viewer_inputs_skip_nested_params(spark):
    from calltrail.functions.render import JSON_LOG_TAG
    head = f"x D {JSON_LOG_TAG}: "
    lines = spark.createDataFrame(
        [(1, head + '{"type":"ENTER","class":"A","method":"m","params":{"a":"1","n":2}}'),
         (2, head + '{"type":"ENTER","class":"A","method":"m","params":{"o":{"k":1}}}'),
         (3, head + '{"type":"ENTER","class":"A","method":"m","params":{"z":null}}')],
        "line_no long, value string")
    cand = L.logcat_candidates(lines, "value", "line_no")
    assert [r["seq"] for r in L.events_of(cand).collect()] == [1]
    assert L.load_report(cand).first()["skipped"] == 2


def test_gz_batches_by_extension(spark, fx, tmp_path):
    d = copy([fx("batch.json.gz")], str(tmp_path / "gz"))
    ev, rej = B.read_batches(spark, d)
    assert ev.count() == 3 and rej.count() == 0


def test_lossless_export_reimports(spark, fx, tmp_path):
    v2, _ = B.read_batches(spark, fx("batch_v2.json"))
    v1, _ = B.read_batches(spark, fx("batch_v1.json"))
    ev = v2.unionByName(v1).drop("batch_id", "pos").withColumn("seq", F.col("ts"))
    out = str(tmp_path / "lossless")
    ST.write_session(ev, out)                      # JSON lines, every field
    back, cand = L.read_session(spark, out)
    cols = [c for c in ev.columns if c != "seq"]
    key = lambda r: r["ts"]
    a = sorted((r.asDict() for r in ev.select(*cols).collect()), key=key)
    b = sorted((r.asDict() for r in back.select(*cols).collect()), key=key)
    assert a == b
    assert L.load_report(cand).agg(F.sum("loaded")).first()[0] == 4


def test_gzip_members_and_cut_bodies():
    two, cut = gzip.compress(b"[1,") + gzip.compress(b"2]"), gzip.compress(b"[1, 2]")[:-8]
    assert B.inflate(two, 100) == ("[1,2]", None)
    assert B.inflate(cut, 100) == (None, "bad gzip body")
    assert B.inflate(two, 4) == (None, "inflated body over 4 bytes")
    assert B.inflate(b"", 100) == ("", None)


def test_caps_are_arguments(spark, tmp_path):
    d = str(tmp_path / "in")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[{"type":"ENTER"}]')
    ev, rej = B.read_batches(spark, d, max_raw=10)
    assert ev.count() == 0 and [r["reason"] for r in rej.collect()] == ["raw body over 10 bytes"]


def test_device_log_skips_null_fields_sessions_default_them(spark, tmp_path):
    body = '{"type":"ENTER","class":null,"method":"m","message":null}'
    lines = spark.createDataFrame([(1, f"D {L.JSON_LOG_TAG}: {body}"),
                                   (2, f'D {L.JSON_LOG_TAG}: {{"type":"EXIT","message":null}}')],
                                  "line_no long, value string")
    assert [r["seq"] for r in L.events_of(L.logcat_candidates(lines, "value", "line_no")).collect()] == [2]
    (tmp_path / "s.json").write_text(f"[{body}]")
    ev, _ = L.read_session(spark, str(tmp_path / "s.json"))
    assert [(r["type"], r["class_name"]) for r in ev.collect()] == [("ENTER", "")]


def test_only_json_arrays_are_read_whole(spark, fx, tmp_path):
    d = copy([fx("logcat.txt")], str(tmp_path / "logs"))
    _, cand = L.read_any(spark, d)
    plan = cand._jdf.queryExecution().optimizedPlan().toString()
    assert "wholetext" not in cand._jdf.queryExecution().toString().lower()
    assert "Relation" in plan


def _events(spark, n, parts):
    rows = [(i // 7, i % 7, "ENTER", "C", f"m{i}", 86_400_000 * (i % 4) + i, f"u{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "batch_id long, pos int, type string, class_name string, method string, "
                                       "ts long, user_id string").repartition(parts)


def test_ids_are_dense_and_follow_the_order_whatever_the_split(spark, tmp_path):
    for parts in (1, 5, 64):
        got = ST.assign_seq(_events(spark, 200, parts), 524_289, str(tmp_path / f"w{parts}")).collect()
        assert sorted((r["seq"] - (524_289 << 36), r["method"]) for r in got) == [(i, f"m{i}") for i in range(200)]
    last = ST.assign_seq(_events(spark, 10, 2), ST._MAX_LOAD, str(tmp_path / "last")).agg(F.max("seq")).first()[0]
    assert last == (ST._MAX_LOAD << 36) + 9
    for bad in (-1, ST._MAX_LOAD + 1):
        try:
            ST.assign_seq(_events(spark, 10, 2), bad, str(tmp_path / "bad"))
            raise AssertionError("must refuse")
        except ValueError:
            pass


def test_a_partial_commit_is_finished_by_a_replay_with_other_splits(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "partial")
    real = ST._move_in

    def one_file_then_crash(s, files, root, prefix):
        day = sorted(d for d in os.listdir(files) if d.startswith("event_date="))[0]
        own = sorted(f for f in os.listdir(f"{files}/{day}") if f.startswith("part-"))[0]
        os.makedirs(f"{root}/{day}")
        os.rename(f"{files}/{day}/{own}", f"{root}/{day}/{prefix}{own.split('-')[1]}{own[own.index('.'):]}")
        raise OSError("crash")

    monkeypatch.setattr(ST, "_move_in", one_file_then_crash)
    try:
        ST.append_events(_events(spark, 200, 3), table, load_id=4)
        raise AssertionError("must crash")
    except OSError:
        pass
    monkeypatch.setattr(ST, "_move_in", real)
    assert ST.append_events(_events(spark, 200, 11), table, load_id=4) > 0
    assert ST.append_events(_events(spark, 200, 2), table, load_id=4) == 0
    got = ST.read_events(spark, table).select("seq", "method").collect()
    assert sorted((r["seq"] - (4 << 36), r["method"]) for r in got) == [(i, f"m{i}") for i in range(200)]
    assert not os.path.exists(f"{table}/_staging/load=4")


def test_a_crash_before_the_ready_mark_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "early")
    real = ST._mark
    monkeypatch.setattr(ST, "_mark", lambda s, p: (_ for _ in ()).throw(OSError("crash")))
    try:
        ST.append_events(_events(spark, 50, 3), table, load_id=1)
        raise AssertionError("must crash")
    except OSError:
        pass
    assert not [d for d in os.listdir(table) if d.startswith("event_date=")]
    monkeypatch.setattr(ST, "_mark", real)
    ST.append_events(_events(spark, 50, 5), table, load_id=1)
    assert ST.read_events(spark, table).select("seq").distinct().count() == 50


def test_rows_appended_during_an_erase_stay(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "busy")
    ST.append_events(_events(spark, 60, 2), table, load_id=1)
    real, more = ST.by_day, []

    def append_first(df):
        if not more:
            more.append(1)
            ST.append_events(_events(spark, 30, 2), table, load_id=2)
        return real(df)

    monkeypatch.setattr(ST, "by_day", append_first)
    assert ST.erase_user(spark, table, "u1") == 20
    left = ST.read_events(spark, table)
    assert left.count() == 40 + 30 and left.where("user_id = 'u1'").count() == 10


def test_erase_touches_only_files_of_the_user(spark, tmp_path):
    table = str(tmp_path / "store 3")
    schema = "seq long, type string, class_name string, method string, ts long, user_id string"
    ST.append_events(spark.createDataFrame([(1, "ENTER", "C", "m", 5, "u0"), (2, "ENTER", "C", "m", 6, "u1"),
                                            (3, "EXIT", "C", "m", 7, None)], schema).coalesce(1), table, load_id=1)
    ST.append_events(spark.createDataFrame([(4, "ENTER", "C", "m", 8, "u2")], schema), table, load_id=2)
    day = os.path.join(table, "event_date=1970-01-01")
    other = [f for f in os.listdir(day) if f.startswith("load-2-")]
    assert ST.erase_user(spark, table, "u1") == 1
    after = [f for f in os.listdir(day) if f.endswith(".parquet")]
    assert len([f for f in after if f in other]) == 1 and len([f for f in after if f.startswith("erased-")]) == 1
    assert [r["seq"] for r in ST.read_events(spark, table).orderBy("seq").collect()] == [1, 3, 4]


def test_erase_changes_nothing_if_rows_would_be_lost(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "store4")
    schema = "seq long, type string, class_name string, method string, ts long, user_id string"
    ST.append_events(spark.createDataFrame([(1, "ENTER", "C", "m", 5, "u0"), (2, "ENTER", "C", "m", 6, "u1")], schema), table, load_id=1)
    real = ST._fs

    def losing(s, path):
        if "_staging" in path:  # the written files are gone before they are counted
            import shutil
            for d in os.listdir(path):
                if d.startswith("event_date="):
                    shutil.rmtree(os.path.join(path, d))
        return real(s, path)

    monkeypatch.setattr(ST, "_fs", losing)
    try:
        ST.erase_user(spark, table, "u1")
        raise AssertionError("must refuse")
    except RuntimeError:
        pass
    assert ST.read_events(spark, table).count() == 2


def test_rendered_bodies_are_files_of_one_folder(spark, tmp_path):
    import gzip
    import os

    from calltrail.plans import stored as Q
    texts = spark.createDataFrame([(0, "[0]"), (1, "[1]"), (2, "é"), (None, "x")], "batch long, value string")
    Q._write_texts(texts, str(tmp_path / "in"))
    got = {n: open(tmp_path / "in" / n, "rb").read() for n in os.listdir(tmp_path / "in")}
    assert sorted(got) == ["batch=0.txt", "batch=1.txt.gz", "batch=2.txt"]
    assert gzip.decompress(got["batch=1.txt.gz"]) == b"[1]\n" and got["batch=2.txt"] == "é\n".encode()


def test_body_shape_and_flat_values_as_before(spark):
    from calltrail.sources import batches as B
    raws = ['{}', '[]', 'null', '5', '"a"', '{"a":1}', '{"a":null}', '{"a":{"b":1}}', '{"a":[1]}', '["x",null]', '["x"]', '[1,"a"]',
            '[{"a":1}]', '{"VOID":1}', '{"a<":"OBJECT<"}', '{"ARRAY<x":1}', '{"a\\nb":null}', '{"a\\nb":2}', 'no', None, '{"a":true,"b":1.5}', '[[1]]']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    sch = F.schema_of_variant(F.try_parse_json("raw"))
    inner = F.substring(sch, F.instr(sch, "<") + 1, 1 << 30)
    old = (sch.isNotNull() & ~inner.contains("OBJECT<") & ~inner.contains("ARRAY<") & ~inner.contains("VOID") & ~inner.contains("VARIANT"))
    assert df.where(~old.eqNullSafe(B._flat_json(F.col("raw")))).collect() == []
    sep = ["", " ", "\n", "\r\n ", "\t\x0b", "\u0085", "  ", " ", "x"]
    bodies = [a + b + c for a in sep for b in ("[", "[]", "[]]", "]", '[{"type":"ENTER"}]', "") for c in sep]
    texts = spark.createDataFrame([(str(i), v) for i, v in enumerate(bodies)], "batch_id string, value string")
    t = F.regexp_replace("value", r"^\s+|\s+$", "")
    no = {r["batch_id"] for r in texts.where(~(t.startswith("[") & t.endswith("]"))).collect()}
    assert {r["batch_id"] for r in B.decode_rows(texts).where("reason = 'not a JSON array'").collect()} == no
    plan = B.decode_rows(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0
