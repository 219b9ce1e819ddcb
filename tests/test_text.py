import pytest
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.operators.tokenize import message_tokens
from quillsift.params import TokenizerConfig
from quillsift.sources.mime import parse_message, parse_messages


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_words(spark):
    assert one(spark, T.words, "Hello, World! test-email_token @x. ...a..") == ["hello", "world", "test-email_token", "@x", "a"]
    assert one(spark, T.words, None) == [] and one(spark, T.words, "") == []
    assert one(spark, T.valid_words, "東京 ab abc " + "x" * 41) == ["東京", "abc"]
    assert one(spark, lambda v: T.bigrams(T.words(v)), "a b c") == ["a_b", "b_c"]
    assert one(spark, lambda v: T.bigrams(T.words(v)), "a") == []


@pytest.mark.parametrize(
    "host,registrable,brand,tld",
    [
        ("partners.intrepidtravel.com", "intrepidtravel.com", "intrepidtravel", "com"),
        ("survey.qatarairways.com.qa", "qatarairways.com.qa", "qatarairways", "com.qa"),
        ("travellerschoice.com.au", "travellerschoice.com.au", "travellerschoice", "com.au"),
        ("cruising.org", "cruising.org", "cruising", "org"),
        ("192.168.1.1", None, None, None),
        ("localhost", None, None, None),
        ("spammer.life", "spammer.life", "spammer", "life"),
        ("::1", None, None, None),
        (None, None, None, None),
    ],
)
def test_hosts(spark, host, registrable, brand, tld):
    r = spark.createDataFrame([(host,)], "h string").select(T.decompose_host(F.col("h")).alias("p"), T.effective_tld(F.col("h")).alias("t")).first()
    assert (r.p.registrable if r.p else None, r.p.brand if r.p else None, r.t) == (registrable, brand, tld)


def test_urls(spark):
    html = """<a href="https://A.example/x?q=1">a</a><img src='http://b.example/i.png#f'><a href=https://c.example/>no</a><a href="/rel">"""
    assert one(spark, T.urls_of_html, html) == ["https://a.example/x", "http://b.example/i.png"]
    assert one(spark, T.urls_of_text, "see https://A.example/p?x (http://b.example/q) httpfoo") == ["https://a.example/p", "http://b.example/q"]
    cut = one(spark, T.normalize_url, "https://x.example/" + "é" * 20)
    assert cut == "https://x.example/" + "é" * 11 and len(cut.encode()) == 40


def test_fold_and_scripts(spark):
    assert one(spark, T.fold, "accᴏunt") == "account" and one(spark, T.fold, "𝗽aypal") == "paypal"
    assert one(spark, T.fold, "café") is None and one(spark, T.fold, "東京") is None and one(spark, T.fold, "plain") is None
    assert one(spark, T.is_mixed_script, "pаypal") and not one(spark, T.is_mixed_script, "привет")
    assert one(spark, T.claimed_brand, "AIdi Support") == "aldl" and one(spark, T.claimed_brand, "appleseed") is None
    assert one(spark, T.auth_tokens, "mx; SPF=Pass x dkim=fail dmarc=1") == ["x:auth:spf_pass", "x:auth:dkim_fail"]
    assert one(spark, T.spf_token, "  SoftFail (x)") == "x:spf:softfail"


RAW = b"""From: "AIdi" <promo@news.shop.example.com.au>\r\nReply-To: help@aldi.example\r\nTo: me@x.example\r\nSubject: =?utf-8?q?Big_Offer_today?=\r
Received: from a.example by b.example; x\r\nReceived: from c.example by d.example; y\r\nAuthentication-Results: mx; spf=pass\r\nMessage-Id: <1@x>\r
Content-Type: multipart/alternative; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nOffer offer OFFER https://a.example/p?q\r\n--B\r
Content-Type: text/html\r\n\r\n<p>Hidden</p><a href="https://b.example/z">go</a><script>var nope</script>\r\n--B--\r\n"""


def tokens(spark, raw, **config):
    df = spark.createDataFrame([("m", bytearray(raw))], "path string, content binary")
    return set(message_tokens(parse_messages(df), TokenizerConfig(**config)).select("tokens").first()[0])


def test_message_tokens(spark):
    t = tokens(spark, RAW)
    assert {"h:subject:big", "h:subject:big_offer", "h:subject:offer_today", "b:offer", "b:hidden", "u:https://a.example/p", "u:https://b.example/z"} <= t
    assert {"h:from:promo@news.shop.example.com.au", "h:from:news.shop.example.com.au", "h:from:example.com.au", "h:from:example", "h:replyto:help@aldi.example", "h:replyto:aldi"} <= t
    assert {"h:received:a.example", "h:received:b.example"} <= t and "h:received:c.example" not in t
    assert not any(x.startswith(("x:", "h:to:", "h:fromname:")) for x in t) and "b:nope" not in t
    more = tokens(spark, RAW, expanded_headers=True, tld_feature=True, brand_mismatch=True, auth_tokens=True)
    assert {"h:hrecv:a.example", "h:hrecvx:c.example", "h:to:me@x.example", "x:tld:com.au", "x:brandmiss:aldl", "h:fromname:aidi", "x:auth:spf_pass"} <= more


def test_odd_messages(spark):
    assert parse_message(b"no headers at all \xff")["text_bodies"] == ["no headers at all �"]
    assert parse_message(b"")["text_bodies"] == [""]
    assert "b:headers" in tokens(spark, b"no headers at all")
    many = b"Subject: x\r\n\r\n" + " ".join(f"w{i}" for i in range(60_000)).encode()
    assert len(tokens(spark, many)) <= 50_100


def test_brands_in_stored_names(spark, tmp_path):
    """Names of every id are examined, and to their ends; brands are given in canonical form."""
    from quillsift.plans import mail

    names = [(20, "AppIe Support"), (21, "AppIe Support"), (40, "Plain Person"), (60, "word " * 30 + "Netf1ix"), (61, "word " * 30 + "Netf1ix")]
    spark.createDataFrame([(i, "a@shop.example", f"h:fromname:{n}") for i, n in names], "token_id bigint, u string, word string").write.parquet(f"{tmp_path}/tokens.parquet")
    got = {tuple(r) for r in mail.brand_mismatch_stored(spark, str(tmp_path)).collect()}
    assert got == {(20, "x:brandmiss:apple"), (21, "x:brandmiss:apple"), (60, "x:brandmiss:netfllx"), (61, "x:brandmiss:netfllx")}
