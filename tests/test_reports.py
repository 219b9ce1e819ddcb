import json

from pyspark.sql import functions as F

from quillsift.__main__ import main
from quillsift.classifier import Classifier
from quillsift.functions import text as T
from quillsift.operators import evaluate as EV
from quillsift.operators import reports as R
from quillsift.operators.tokenize import body_tokens
from quillsift.params import ScoreParams, TokenizerConfig
from quillsift.sources import files as FI
from quillsift.sources import sinks


def test_brand_claims(spark):
    """Names in disguise that claim a brand; the owner's own brand is no claim."""
    names = ["AppIe Support", "PayPa1 Service", "C0les Rewards", "Netf1ix", "x" * 200 + " paypal", "Garden Club", "PayPal"]
    owners = ["a@shop.example"] * 6 + ["b@mail.paypal.com"]
    df = spark.createDataFrame(list(zip(names, owners)), "name string, u string")
    got = [[t for t in r[0] if t.startswith("x:brandmiss:")] for r in df.select(T.name_tokens(F.col("name"), F.col("u"))).collect()]
    assert [len(g) for g in got] == [1, 1, 1, 1, 1, 0, 0]


def test_digest(spark):
    rows = [("a", 9000, 9000, 7, 0), ("b", 9000, 9000, 4, 2), ("c", 10, 10, 9, 0), ("d", 9000, 9000, 0, 0)]
    u = spark.createDataFrame(rows, "u string, good bigint, spam bigint, fn bigint, fp bigint")
    assert [r.u for r in R.top_missed(u).collect()] == ["c", "a", "b"]
    assert [r.u for r in R.threshold_candidates(u).collect()] == ["a"] and [r.u for r in R.with_false_positives(u).collect()] == ["b"]


def test_divergence_and_errors(spark):
    p = spark.createDataFrame([("a", 5, 2), ("b", 9, 2), ("c", 9, 2), ("d", 1, 3)], "u string, n bigint, disagree bigint")
    assert [(r["rank"], r.u) for r in R.most_divergent(p, 3).orderBy("rank").collect()] == [(1, "d"), (2, "b"), (3, "c")]
    e = spark.createDataFrame([(3, True, False), (1, False, True), (2, True, True)], "msg_id int, is_spam boolean, pred_spam boolean")
    assert [r.msg_id for r in R.shown_errors(e, 5).collect()] == [1, 3] and [r.msg_id for r in R.shown_errors(e, 1).collect()] == [1]


def test_tune_outcomes(spark):
    totals = spark.createDataFrame([("a", 200, 60), ("b", 200, 60), ("c", 99, 900), ("d", 200, 60), ("e", 300, None)], EV.__name__ and "u string, total_good bigint, total_spam bigint")
    knobs = {k: getattr(ScoreParams(), k) for k in EV.KNOBS}
    gated = spark.createDataFrame([("a", True, None), ("b", False, "fp")], "u string, write boolean, refused string").select("*", *(F.lit(v).alias(k) for k, v in knobs.items()))
    assert dict(EV.tune_summary(gated, totals).collect()) == {"written": 1, "refused: fp": 1, "skipped": 2, "failed": 1}
    files = EV.tuned_params(gated.withColumn("threshold", F.lit(0.7)), {"a": "# mine\nthreshold = 0.6\nrail = on\n", "b": "threshold = 0.6\n"})
    assert list(files) == ["a"] and "threshold = 0.7" in files["a"] and "# mine" in files["a"] and "rail = on" in files["a"]
    assert len(sinks.tune_report(gated).collect()) == 2


def test_eval_report(spark):
    rows = [(True, True, 0.9, "x"), (True, False, 0.2, "x"), (False, False, 0.1, "y"), (False, True, 0.8, "y")]
    df = spark.createDataFrame(rows, "is_spam boolean, pred_spam boolean, score double, folder string")
    (line,) = [json.loads(r.line) for r in sinks.eval_report(df, folders=True).collect()]
    assert (line["fp"], line["fn"], line["tp"], line["tn"]) == (1, 1, 1, 1) and line["percentiles"]["ham_p99"] == 0.8 and len(line["folders"]) == 2
    assert list(line) == sorted(line)


def test_raw_token_cap(spark):
    df = spark.createDataFrame([(" ".join(f"word{i}" for i in range(60_000)),)], "t string")
    n = lambda c: df.select(F.size(body_tokens(F.col("t"), c))).first()[0]
    assert n(TokenizerConfig()) == 50_000 and n(TokenizerConfig(max_raw_tokens=None)) == 60_000


def test_deliveries_of_lines(spark):
    line = lambda **k: json.dumps({"type": "delivery", "u": "a@x", "msgid": "1", "verdict": "SPAM", "folder": "J", "score": 0.9} | k)
    lines = [line(), line(verdict="GOOD"), line(u="b@x"), line(type="train"), line(msgid="2", folder=None), "broken", line(msgid="3", score="0.9")]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    got = {(r.u, r.msgid): r.verdict for r in FI.load_deliveries(df).collect()}
    assert got[("a@x", "1")] == "GOOD" and ("b@x", "1") in got and ("a@x", "2") not in got
    assert {r.u for r in FI.load_deliveries(df, "b@x").collect()} == {"b@x"}


def test_stats_tree(spark, tmp_path):
    for user, text in (("ann", '{"d":"2026-01-01","db":[1,2]}\n{"d":"2026-01-02","db":[3,4]}\nbroken\n'), ("bob", "broken\n")):
        p = tmp_path / "X.example" / "msg" / user
        p.mkdir(parents=True)
        (p / "spam-stats.jsonl").write_text(text)
    rows = FI.read_stats_tree(spark, f"file://{tmp_path}").collect()
    assert [(r.u, r.d, r.db) for r in rows] == [("ann@x.example", "2026-01-02", [3, 4])]
    assert FI.first_look_back(spark, f"file://{tmp_path}").count() == 2


def test_sniff_anywhere(spark):
    raw = [b"Subject: x\r\n\r\nbody\r\nMessage-ID: <a\"b\\c@x>\r\n", b"nothing", b"message-id: " + b"y" * 300]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "c binary")
    got = [r[0] for r in df.select(FI.sniff_msgid_anywhere(F.col("c"))).collect()]
    assert got == ['<a\\"b\\\\c@x>', None, "y" * 200]


def test_sql_functions(spark):
    sinks.register_functions(spark)
    hosts = ["mail.shop.com.au", "a.b.example", "10.0.0.1", "::1", "localhost", "x.co", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    parts = T.decompose_host(F.col("host"))
    for r in df.select(F.expr("host_brand(host)"), parts["brand"], F.expr("effective_tld(host)"), T.effective_tld(F.col("host"))).collect():
        assert r[0] == r[1] and r[2] == r[3]
    from quillsift.operators.score import chi2_survival

    x = spark.createDataFrame([(0.0, 2), (3.0, 4), (80.0, 40), (5.0, 2)], "x double, n int")
    for r in x.select(F.expr("chi2_survival(x, n)"), chi2_survival(F.col("x"), F.expr("n div 2"))).collect():
        assert abs(r[0] - r[1]) < 1e-12
    u = spark.createDataFrame([("HTTPS://A.example/" + "ä" * 40 + "?q",), ("http://x.y/#z",)], "url string")
    assert all(r[0] == r[1] for r in u.select(F.expr("normalize_url(url)"), T.normalize_url(F.col("url"))).collect())


def test_training_until_sure(spark, tmp_path):
    msgs = spark.createDataFrame([("a", 1, ["b:x", "b:y"]), ("a", 2, ["b:x", "b:z"])], "u string, msg_id bigint, tokens array<string>")
    c = Classifier(spark, f"file://{tmp_path}/m", ScoreParams(train_max_reps=6, combine_mode="geometric"))
    c.good(msgs.filter("msg_id = 2"))
    c.spam(msgs.filter("msg_id = 1"))
    tokens, totals = c.store.open()
    n = {r.token: r.spam for r in tokens.collect()}
    assert n["b:y"] > 1 and totals.first().total_spam == 1


def test_commands(capsys):
    assert main(["version"]) == 0 and main(["help"]) == 0 and main(["nonsense"]) == 2
    assert "quillsift" in capsys.readouterr().out
