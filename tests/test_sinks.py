from quillsift.sources import sinks


def test_reports_and_appends(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-01", 1), ("b", "2026-01-01", None)], "u string, d string, fn bigint")
    assert sorted(r.line for r in sinks.report_json(df).collect())[0] == '{"d":"2026-01-01","fn":1,"u":"a"}'
    path = f"file://{tmp_path}/stats"
    assert sinks.append_once(df.limit(1), path, "u", "d") == 1
    assert sinks.append_once(df, path, "u", "d") == 1 and sinks.append_once(df, path, "u", "d") == 0
    assert spark.read.schema(df.schema).json(path).count() == 2
    pair = spark.createDataFrame([("t", "v", "score", "u", "<m>", "SPAM", 0.9, "GOOD", 0.1)], "t string, v string, cmd string, user string, msgid string, p_verdict string, p_score double, c_verdict string, c_score double")
    assert '"primary":"SPAM 0.900000","cand":"GOOD 0.100000"' in sinks.shadow_lines(pair).first().line
    e = spark.createDataFrame([("u", 1, [(1, "w", 2, 3, 0.9), (2, "v", 3, 2, 0.1)])], "u string, msg_id bigint, top_tokens array<struct<rn:int,word:string,good:bigint,spam:bigint,f:double>>")
    a, b = (r.line for r in sinks.explain_lines(e).orderBy("rn").collect())
    assert a.endswith(".....|...>.") and b.endswith(".<...|.....")


def test_sql_functions(spark):
    sinks.register_functions(spark)
    r = spark.sql("SELECT token_prob(0, 10, 10, 10), token_prob(NULL, NULL, 1, 1), host_brand('a.shop.com.au'), host_brand('x.shop.example'), host_brand('1.2.3.4'), tokenize_text('Hello hello, big-World ab')").first()
    assert abs(r[0] - 10.5 / 11) < 1e-9 and r[1] == 0.5 and (r[2], r[3], r[4]) == ("shop", "shop", None) and r[5] == ["big-world", "hello"]
