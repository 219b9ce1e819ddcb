from pyspark.sql import functions as F

from quillsift.operators import events as E
from quillsift.operators import reports as R
from quillsift.sources import files as S

P = "2026-02-01T00:00:00 mx dovecot: lmtp(a@b)<1><S1>: "


def lines(spark, *xs):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], "file string, line_no bigint, line string")


def test_parse_and_stitch(spark):
    df = lines(
        spark,
        P + "sieve: DEBUG: DELIVERY: a@b -> Junk (SPAM 0.9)",
        P + "sieve: msgid=<1@x>: stored mail into mailbox 'Junk'",
        P + "sieve: DEBUG: TRAIN: a@b -> good ",
        P.replace("S1", "S2") + "sieve: DEBUG: DELIVERY: a@b -> In (x) (GOOD 0.1)",
        P.replace("S1", "S3") + "sieve: msgid=<9@x>: fileinto action: stored mail into mailbox 'A'",
        P + "sieve: DEBUG: TRAIN: a@b -> maybe",
        P + "sieve: msgid=<2@x>: nothing stored",
        "noise",
        None,
    )
    ev = E.parse_lines(df)
    assert sorted((r.kind, r.sess) for r in ev.collect()) == [("D", "S1"), ("D", "S2"), ("M", "S1"), ("M", "S3"), ("T", "S1")]
    got = {r.sess: (r.folder, r.verdict, r.msgid) for r in E.stitch(ev).collect()}
    assert got["S1"] == ("Junk", "SPAM", "<1@x>") and got["S2"][2] is None
    assert E.harvest_totals(E.stitch(ev)).first().orphans == 1
    assert [tuple(r) for r in E.train_summary(ev).collect()] == [("a@b", 1, 0)]


def test_pairing_rules(spark):
    rows = [("D", 1, "a"), ("D", 2, "a"), ("M", 3, "a"), ("M", 4, "a"), ("D", 5, "a"), ("M", 1, "b"), ("D", 2, "b")]
    df = spark.createDataFrame([("f", n, k, None, s, None, None, None, None, f"m{n}" if k == "M" else None) for k, n, s in rows], "file string, line_no bigint, kind string, t string, sess string, u string, verdict string, score string, folder string, msgid string")
    assert sorted((r.sess, r.line_no, r.msgid) for r in E.stitch(df).collect()) == [("a", 2, "m3"), ("a", 5, None), ("b", 2, None)]


def test_labels(spark):
    v = [("SPAM", ".Junk", 0.9), ("SPAM", "INBOX", 0.9), ("GOOD", ".junk", 0.1), ("GOOD", "INBOX", 0.1), ("ODD", "INBOX", 0.5)]
    d = spark.createDataFrame(v, "v string, f string, s double").select(E.label(F.col("v"), F.col("f")), E.confidence(F.col("s")), E.is_algo_error(F.col("s"), F.col("f")))
    assert [tuple(r) for r in d.collect()] == [("tp", "high_spam", False), ("fp", "high_spam", True), ("fn", "high_ham", True), ("tn", "high_ham", False), ("unknown", "uncertain", False)]
    bands = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.21, 0.5, 0.79, 0.8, 1.0)], "s double").select(E.confidence(F.col("s")))
    assert [r[0] for r in bands.collect()] == ["high_ham", "high_ham", "uncertain", "uncertain", "uncertain", "high_spam", "high_spam"]


def test_reports(spark):
    rec = spark.createDataFrame([("a", "SPAM", 0.9, "GOOD", 0.3), ("a", "GOOD", 0.1, "SPAM", 0.8), ("b", "GOOD", 0.1, "GOOD", 0.1)], "u string, p_verdict string, p_score double, c_verdict string, c_score double")
    a = {r.u: r for r in R.shadow_per_user(rec).collect()}
    assert (a["a"].stricter, a["a"].laxer, a["b"].agree) == (1, 1, 1)
    assert R.shadow_totals(rec).first().agree_rate == 0.333333
    users = spark.createDataFrame([("A@x",), ("b@x",)], "u string")
    allow = lambda *e: spark.createDataFrame([(x,) for x in e], "entry string")
    assert [r.u for r in R.allowed(users, allow("a@X")).collect()] == ["A@x"] and R.allowed(users, allow("*", "zz")).count() == 2
    p = spark.createDataFrame([("SPAM 0.5",), ("HAM 1",), ("GOOD x",)], "r string").select(*R.parse_verdict("r"))
    assert [tuple(r) for r in p.collect()] == [("SPAM", 0.5), (None, None), ("GOOD", None)]


def test_sniffing_and_folders(spark, tmp_path):
    for name, text in {"cur/1": "A: b\nmessage-ID: <1@\n x>\nX-Spam-Status: SPAM 0.75\n\nbody", ".Junk/cur/2": "\nMessage-Id: <no>", ".Trash/cur/3": "x", "new/4": "y"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    df = S.read_maildir(spark, f"file://{tmp_path}")
    got = {r.folder: (r.m, r.v) for r in df.select("folder", S.sniff_msgid(F.col("content")).alias("m"), S.sniff_verdict(F.col("content")).alias("v")).collect()}
    assert set(got) == {"INBOX", ".Junk"} and got["INBOX"][0] == "<1@ x>" and got["INBOX"][1].score == 0.75 and got[".Junk"][0] is None
    assert S.read_folder(spark, f"file://{tmp_path}/none").count() == 0


def test_model_store_and_facade(spark, tmp_path):
    import pytest

    from quillsift.classifier import Classifier

    c = Classifier(spark, f"file://{tmp_path}/model")
    with pytest.raises(FileNotFoundError):
        c.store.open_existing()
    assert not (tmp_path / "model").exists()
    raw = lambda i, t: ("a", i, bytearray(f"Subject: {t}\n\n{t} text".encode()))
    ddl = "u string, msg_id bigint, content binary"
    spam, ham = spark.createDataFrame([raw(i, f"winner prize{i}") for i in range(4)], ddl), spark.createDataFrame([raw(10 + i, f"meeting notes{i}") for i in range(4)], ddl)
    assert c.spam(spam) == 1 and c.good(ham) == 2
    got = {r.msg_id: r for r in c.score(spark.createDataFrame([raw(1, "winner prize"), raw(2, "meeting")], ddl)).collect()}
    assert got[1].verdict == "SPAM" and got[2].verdict == "GOOD" and got[1].line == f"SPAM {got[1].score:.6f}"
    n = c.counts().first()
    assert (n.total_good, n.total_spam) == (4, 4)
    lines = c.export().collect()
    assert lines[0].line == '4,4,0,"__total__"' and [r.line for r in lines[1:]] == sorted((r.line for r in lines[1:]), key=lambda x: x.split(",", 3)[3])
    d = Classifier(spark, f"file://{tmp_path}/other")
    d.import_(spark.createDataFrame(lines))
    assert {tuple(r) for r in d.export().collect()} == {tuple(r) for r in lines}
    c.cleanup(1, 0)
    assert c.counts().first().tokens < n.tokens
    assert c.receive(spam, 0.2, 7).count() == 4 and c.counts().first().total_spam == 8


def test_json_lines(spark):
    df = spark.createDataFrame([('{"user":"a","primary":"SPAM 0.1","cand":"GOOD 0.2"}',), ("{bad",), ("",)], "line string")
    r = S.read_json_lines(df, S.SHADOW_JSON).collect()
    assert sorted((x.user or "", x.bad) for x in r) == [("", True), ("a", False)]
    ev = spark.createDataFrame([("t", "u", "SPAM", "0.5", "f", None, "s"), ("t", "u", "GOOD", "x", "f", "<m>", "s")], "t string, u string, verdict string, score string, folder string, msgid string, sess string")
    a, b = (r.line for r in S.event_json(ev).collect())
    assert '"score":0.5' in a and "msgid" not in a and '"score":"x"' in b


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"a{i}" for i in range(500)))
    (tmp_path / "b.log").write_text("b0\n\nb2\n")
    rows = S.read_lines(spark, [f"file://{tmp_path}/a.log", f"file://{tmp_path}/b.log"]).collect()
    got = {(r.file[-5:], r.line_no): r.line for r in rows}
    assert len(rows) == len(got) == 503 and got["a.log", 1] == "a0" and got["a.log", 500] == "a499" and got["b.log", 3] == "b2"
