from pyspark.sql import functions as F

from sparkloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms_and_names(spark):
    assert one(spark, T.query_terms(F.lit("Please fix the getUser AND getUser in auth_service v2 of it"))) == ["getuser", "auth_service"]
    assert one(spark, T.camel_parts(F.lit("parseHTTPRequestId"))) == ["parse", "http", "request"]
    assert one(spark, T.name_keywords(F.lit("load_user"))) == ["load_user", "load", "user"]
    assert one(spark, T.symbol_terms(F.lit("src/auth.handleLogin x"))) == ["src", "auth", "handlelogin"]


def test_token_estimate(spark):
    for text, n in (("", 0), ("a", 1), ("a" * 9, 2), (None, 0)):
        assert one(spark, T.token_estimate(F.lit(text).cast("string"))) == n


def test_lines_drop_only_the_last_empty_one(spark):
    assert one(spark, T.text_lines(F.lit("a\r\nb\rc\n\n"))) == ["a", "b", "c", ""]
    assert one(spark, T.text_lines(F.lit(""))) == []


def test_classifiers(spark):
    assert one(spark, T.task_type(F.lit("please AUDIT this"))) == "exhaustive"
    assert one(spark, T.task_type(F.lit("a deadlock somewhere"))) == "behavioral"
    assert one(spark, T.task_type(F.lit(" [task_type:targeted] audit"))) == "targeted"
    assert one(spark, T.query_intent(F.lit("routes without auth"))) == "absence_query"
    assert one(spark, T.query_intent(F.lit("n+1 calls"))) == "control_flow"
    assert one(spark, T.query_intent(F.lit("rename a thing"))) == "general"


def test_smart_case():
    assert T.smart_case("foo") == "(?i)foo" and T.smart_case("Foo") == "Foo" and T.smart_case(r"a\|b") == "(?i)a|b" and T.smart_case(r"\Sfoo") == r"(?i)\Sfoo"


def test_paths(spark):
    assert one(spark, T.normal_path(F.lit("a/b/../c/./d"))) == "a/c/d"
    assert one(spark, T.normal_path(F.lit("../x"))) == "../x"
    assert one(spark, T.path_prefixes(F.lit("a/b/c.py"))) == ["a", "a/b"]
    assert one(spark, T.stem(F.lit("x/y.test.ts"))) == "y.test" and one(spark, T.suffix(F.lit("x/y.test.ts"))) == ".ts"
    assert one(spark, T.test_stem(F.lit("tests/test_User.py"))) == "user"
    for ref, local in (("src/a.ts", True), ("src/a.ts::f", True), ("@scope/a.ts", False), ("http://x/a.ts", False), ("a.ts", False), ("src/dir", False), ("", False)):
        assert one(spark, T.is_local_file(F.lit(ref))) is local


def test_commands(spark):
    for c, kind in (("rm -rf build", "hard"), ("cd x && rm -r y", "hard"), ("echo a > f", "soft"), ("echo a >> f", "none"), ("rm f", "soft"), ("ls", "none")):
        assert one(spark, T.destructive(F.lit(c))) == kind, c
    for c, yes in (("git log | grep x", False), ("cd a && grep x b", True), ("cat f", True), ("npm test", False)):
        assert one(spark, T.explores(F.lit(c))) is yes, c


def test_defaults(spark):
    assert one(spark, T.clean_host(F.lit("  HOST "))) == "host" and one(spark, T.clean_host(F.lit(" "))) == "unknown"
    assert one(spark, T.clean_session(F.lit("a b/c-1"))) == "a_b_c-1" and one(spark, T.or_default(F.lit(""), "z")) == "z"
