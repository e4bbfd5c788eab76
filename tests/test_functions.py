"""Scalar functions on hand-written values (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from calltrail.functions import masking as M
from calltrail.functions import render as R
from calltrail.operators.filters import safe_regex


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [
    ("auth failed: Bearer eyJhb.abc.def", "auth failed: Bearer ***"),
    ("password = foo bar", "password=*** bar"),
    ("token: abc", "token:***"),
    ("token=Bearer abc", "token=*** abc"),
    ("x eyJa.b-c.d_e y", "x *** y"),
    ("bearer =abc", "bearer=***"),
    ("nothing secret here", "nothing secret here"),
])
def test_mask_text(spark, text, expected):
    assert one(spark, M.mask_text, text) == expected


def test_mask_params_words_and_regex(spark):
    df = spark.createDataFrame([({"userPassword": "p", "shipping": "s", "name": "n", "API_KEY": "k"},)],
                               "p map<string,string>")
    w = df.select(M.mask_params_by_words("p").alias("m")).first()["m"]
    assert w == {"userPassword": "***", "shipping": "***", "name": "n", "API_KEY": "k"}
    caps = df.select(M.mask_params_by_words("p", ["Password"]).alias("m")).first()["m"]
    assert caps["userPassword"] == "p"  # capitals in a word never match (reference behaviour)
    fold = df.select(M.mask_params_by_words("p", ["Password"], fold_words=True).alias("m")).first()["m"]
    assert fold["userPassword"] == "***"
    off = df.select(M.mask_params_by_words("p", []).alias("m")).first()["m"]
    assert off["userPassword"] == "p"
    rx = df.select(M.mask_params_by_regex("p").alias("m")).first()["m"]
    assert rx == {"userPassword": "***", "shipping": "***", "name": "n", "API_KEY": "***"}


@pytest.mark.parametrize("ms,text", [(0, "0ms"), (999, "999ms"), (1000, "1s 0ms"), (59999, "59s 999ms"),
                                     (60000, "1m 0s"), (3723004, "62m 3s"), (None, None)])
def test_format_duration(spark, ms, text):
    assert one(spark, R.format_duration, ms, "long") == text


@pytest.mark.parametrize("raw,clean", [("A$b$1", "A.b"), ("A$Companion", "A.Companion"), ("Foo$$Lambda$1", "Foo"),
                                       ("a.b.C", "a.b.C"), ("com/x/LoginViewModel$login$1", "LoginViewModel.login"),
                                       ("$1", "$1")])
def test_clean_class_name(spark, raw, clean):
    assert one(spark, R.clean_class_name, raw) == clean


@pytest.mark.parametrize("raw,clean", [("<init>", "init"), ("getUsername", "username"), ("setUsername", "username="),
                                       ("invokeSuspend", "{coroutine}"), ("get", "get"), ("getx", "getx"),
                                       ("load", "load")])
def test_clean_method_name(spark, raw, clean):
    assert one(spark, R.clean_method_name, raw) == clean


def test_labels_and_truncate(spark):
    df = spark.createDataFrame([("t", "m", "android-jvm"), ("", "m", None), ("t", "", ""), ("", "", "x-os")],
                               "tag string, device_model string, platform string")
    rows = df.select(R.device_label().alias("a"), R.device_group_label().alias("b"),
                     R.platform_label().alias("c")).collect()
    assert [tuple(r) for r in rows] == [("m (t)", "m (t)", "Android"), ("m", "m", ""), ("t", "t", ""),
                                        ("", "(unknown)", "x-os")]
    assert one(spark, R.truncate_value, None) == "null"
    assert one(spark, R.truncate_value, "x" * 201) == "x" * 200 + "..."
    assert one(spark, R.truncate_value, "x" * 200) == "x" * 200


def test_split_stack(spark):
    raw = "  Error: boom\n    at f (a.js:1:1)\n\n\t at g (b.js:2:2)  \n"
    assert one(spark, lambda c: F.array_join(R.split_stack(c), "|"), raw) == "Error: boom|at f (a.js:1:1)|at g (b.js:2:2)"


def test_safe_regex(spark):
    assert safe_regex(spark, "   ") is None
    assert safe_regex(spark, "a.c") == "(?iu)a.c"
    bad = safe_regex(spark, "a(b")
    df = spark.createDataFrame([("xa(by",), ("ab",)], "s string")
    assert [r["s"] for r in df.where(F.col("s").rlike(bad)).collect()] == ["xa(by"]


def test_detail_and_extra_order(spark):
    df = spark.createDataFrame(
        [("EXIT", '{"result": "p", "z": "1"}', "r", 1500, None, None, None, None, 3)],
        "type string, params string, result string, duration_ms long, exception string, "
        "message string, try_start_line int, condition_result boolean, line int")
    df = df.withColumn("params", F.from_json("params", "map<string,string>"))
    r = df.select(F.to_json(R.extra_map()).alias("e"), R.detail().alias("d")).first()
    assert r["e"] == '{"result":"r","z":"1","durationMs":"1500"}'  # a set field replaces the param in place
    assert r["d"] == "result: r  [1s 500ms]"


def test_noise_and_file_filters(spark):
    from calltrail.operators import filters as FL
    rows = [(1, "com.app.MainActivity", "onCreate", "/src/Main.kt"),
            (2, "com.app.Hilt_MainActivity", "inject", "/src/Main.kt"),
            (3, "com.app.Repo", "access$load", "/src/Repo.kt"),
            (4, "com.app.Repo", "getName", "/src/Repo.kt"),
            (5, "com.sdk.internal.Sender", "send", "/app/node_modules/sdk/x.js"),
            (6, "com.app.Repo", "load$default", "\u0000polyfill:external-require"),
            (7, "com.app.Cart", "add", "/app/vendor/runtime/index.js"),
            (8, "com.app.Cart", "setup", "")]
    df = spark.createDataFrame(rows, "seq long, class_name string, method string, file string")
    kept = [r["seq"] for r in FL.drop_noise(df, self_package="com.sdk.").orderBy("seq").collect()]
    assert kept == [1, 7, 8]          # DI class, accessors, $default, getter, own package dropped
    files = [r["seq"] for r in FL.exclude_files(df, patterns=[r"Repo\.kt$"], runtime_paths=["/vendor/runtime/"])
             .orderBy("seq").collect()]
    assert files == [1, 2]            # NUL, node_modules, runtime path, pattern, missing file dropped


def test_viewer_device_filter_and_bounds(spark):
    from calltrail.operators import filters as FL
    rows = [(1, "ENTER", "Cart", "add", 10, "QA-1", "Pixel 7", "google"),
            (2, "ENTER", "Cart", "add", 20, "", "Pixel 7", "google"),
            (3, "CATCH", "Cart", "add", 30, "qa-1", "Pixel 7", "google"),
            (4, "WEIRD", "Cart", "add", 40, "QA-1", "Pixel 7", "google")]
    df = spark.createDataFrame(rows, "seq long, type string, class_name string, method string, ts long, "
                                     "tag string, device_model string, device_manufacturer string")
    got = FL.viewer_query(df, device="Pixel 7 (QA-1)", tag="qa", class_filter="CART", method_filter="a(",
                          from_ms=10, to_ms=40).collect()
    assert [r["seq"] for r in got] == []      # "a(" is invalid: matched literally, so nothing matches
    got = FL.viewer_query(df, device="Pixel 7 (QA-1)", tag="qa", class_filter="CART", from_ms=10, to_ms=40)
    assert [r["seq"] for r in got.collect()] == [1]   # WEIRD type dropped (F4), lower-case tag row is another device


def test_stringify_writes_null_as_text(spark):
    from calltrail.functions.masking import params_from_json
    row = spark.createDataFrame([('{"a": null, "b": 1, "c": "x"}',)], "t string").select(params_from_json("t").alias("m")).first()
    assert row["m"] == {"a": "null", "b": "1", "c": "x"}


def test_filter_folds_case_beyond_ascii(spark):
    from calltrail.operators.filters import safe_regex
    df = spark.createDataFrame([("ÖdemeEkranı",), ("x",)], "c string")
    assert df.where(F.col("c").rlike(safe_regex(spark, "ödeme"))).count() == 1
