"""Queries of the mail operators: tokens, models, scores, evaluation, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.operators import evaluate as EV
from quillsift.operators import events as E
from quillsift.operators import model as M
from quillsift.operators import reports as R
from quillsift.operators import score as S
from quillsift.operators import tokenize as TK
from quillsift.params import ScoreParams
from quillsift.sources.mime import parse_messages
from quillsift.shared import materialize, scratch_path, spread_hint, table, with_references


def documents(spark, d) -> DataFrame:
    """Messages: the texts of ``documents``, spread over all cores where the table is a file or two."""
    df = table(spark, d, "documents").select("doc_id", "u", "text", "folder", "received_at")
    return spread_hint(df.filter("text is not null"))


def tokens_of(spark, d) -> DataFrame:
    return TK.text_tokens(documents(spark, d))


def labels(spark, d) -> DataFrame:
    """The last label of each message: ``msg_id, is_spam, at``."""
    m = table(spark, d, "message_label").filter(F.lower("label").isin("good", "spam"))
    last = m.groupBy(F.col("doc_id").alias("msg_id")).agg(F.max(F.struct("labelled_at", F.lower("label").alias("l"))).alias("m"))
    return last.select("msg_id", (F.col("m.l") == "spam").alias("is_spam"), F.col("m.labelled_at").alias("at"))


def messages(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("u", F.col("doc_id").alias("msg_id"))


def trained(spark, d, tokens=None):
    """Tokens, model and totals. The tokens are written once: training and scoring both read them."""
    t = materialize(tokens_of(spark, d), "tokens") if tokens is None else tokens
    return t, M.train_tokens(t, labels(spark, d)), M.train_totals(messages(spark, d), labels(spark, d))


def stored(spark, d):
    return M.from_tables(table(spark, d, "tokens"), table(spark, d, "model_totals"))


# --- tokens


def tokenize_body(spark, d):
    return documents(spark, d).select("doc_id", F.explode(TK.body_tokens(F.col("text"))).alias("token"))


def subject_unigrams(spark, d):
    w = F.array_distinct(T.valid_words(TK.first_line(F.col("text"))))
    return documents(spark, d).select("doc_id", F.explode(w).alias("word"))


def subject_bigrams(spark, d):
    b = F.array_distinct(T.bigrams(T.valid_words(TK.first_line(F.col("text")))))
    return documents(spark, d).select("doc_id", F.explode(b).alias("bigram"))


def token_doc_freq(spark, d):
    return tokens_of(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


def url_normalize(spark, d):
    u = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"https?://[^\s\"'<>)\]|]+"), F.lit(0))).alias("url")
    return documents(spark, d).select("doc_id", u).select("doc_id", "url", T.normalize_url(F.col("url")).alias("normal"))


def _hosts(spark, d):
    h = F.regexp_extract("word", r"@([^@\s]+)$", 1)
    return table(spark, d, "tokens").select(h.alias("host")).filter("host <> ''").distinct()


def host_decompose(spark, d):
    p = T.decompose_host(F.col("host"))
    return _hosts(spark, d).select("host", p["registrable"].alias("registrable"), p["brand"].alias("brand"))


def effective_tld(spark, d):
    return _hosts(spark, d).select("host", T.effective_tld(F.col("host")).alias("tld"))


def email_address_tokens(spark, d):
    a = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z0-9]"), F.lit(0))).alias("address")
    t = F.explode(T.address_tokens("h:from:", F.col("address"), tld=True)).alias("token")
    return documents(spark, d).select(a).distinct().select("address", t)


def homoglyph_fold(spark, d):
    w = F.lower("word")
    return table(spark, d, "tokens").select("token_id", T.fold(w).alias("skeleton")).filter("skeleton is not null")


def mixed_script_flag(spark, d):
    body = F.regexp_replace("word", "^(b|u|h:[a-z]+):", "")
    return table(spark, d, "tokens").filter(T.is_mixed_script(body)).select("token_id", "word")


def brand_mismatch(spark, d):
    """Every stored display name, whole: the brand of its owner's domain, and the token where it claims another one."""
    t = table(spark, d, "tokens").filter(F.col("word").startswith("h:fromname:"))
    name = t.select("token_id", "u", F.substring("word", F.lit(12), F.length("word")).alias("name"))
    hit = F.filter(T.name_tokens(F.col("name"), F.col("u")), lambda x: x.startswith("x:brandmiss:"))
    own = T.canonical(T.decompose_host(F.try_element_at(F.split(F.lower("u"), "@"), F.lit(2)))["brand"])
    return name.select("token_id", own.alias("own"), F.try_element_at(hit, F.lit(1)).alias("token"))


def auth_tokens(spark, d):
    h = F.concat(F.lit("mx.example; SPF="), F.when(F.col("verdict") == "GOOD", "pass").otherwise("Fail"), F.lit(" smtp.mailfrom=a; dkim="), F.lower(F.coalesce("verdict", F.lit(""))), F.lit("1; dmarc=none"))
    t = F.concat(T.auth_tokens(h), F.array_compact(F.array(T.spf_token(F.concat(F.lit("  "), F.col("verdict"), F.lit(" (mx)"))))))
    return table(spark, d, "delivery_start").select("row_id", F.explode(t).alias("token"))


def html_to_tokens(spark, d):
    """Texts wrapped as HTML parts: tags, entities and addresses in attributes."""
    html = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit('</p><a href="https://a.example/p?q=1">go</a></body>'))
    none = F.lit(None)
    df = documents(spark, d).select(
        "doc_id", F.array(html).alias("html_bodies"), none.cast("string").alias("subject"), F.array().cast("array<string>").alias("text_bodies"),
        *(none.cast("array<struct<name:string,address:string>>").alias(c) for c in ("from_", "reply_to", "sender", "to", "cc")),
        none.cast("array<struct<from_host:string,by_host:string>>").alias("received"),
        none.cast("array<string>").alias("auth_results"), none.cast("array<string>").alias("received_spf"),
    )
    return TK.message_tokens(df).select("doc_id", F.explode("tokens").alias("token"))


def mime_tokens(spark, d):
    """Every text as a raw message with folded headers and an encoded body, through the parser and the tokenizer."""
    docs = documents(spark, d)
    head = F.concat(F.lit("From: Sender <"), F.coalesce("u", F.lit("none@x.example")), F.lit(">\r\nReceived: from a.example\r\n\tby mx.b.example; now\r\nReceived: from c.example by a.example\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"))
    raw = docs.select(F.col("doc_id").alias("path"), F.encode(F.concat(head, F.base64(F.encode("text", "UTF-8"))), "UTF-8").alias("content"))
    return TK.message_tokens(parse_messages(raw)).select(F.col("path").alias("doc_id"), F.explode("tokens").alias("token"))


# --- models


def train_model(spark, d):
    return M.train_tokens(tokens_of(spark, d), labels(spark, d)).select("u", "token", "good", "spam")


def model_totals(spark, d):
    return M.train_totals(messages(spark, d), labels(spark, d))


def model_counts_by_user(spark, d):
    return M.counts(*stored(spark, d))


def model_merge(spark, d):
    t, _ = stored(spark, d)
    return M.merge_tokens(t, train_model(spark, d).withColumn("last_seen", F.lit(None).cast("timestamp"))).select("u", "token", "good", "spam")


NOW = "2026-05-01 00:00:00"


def model_cleanup(spark, d):
    return M.cleanup(stored(spark, d)[0], 1, 30, NOW).select("u", "token", "good", "spam")


def model_export(spark, d):
    return M.export_lines(*stored(spark, d)).select("u", "line")


def model_import(spark, d):
    lines = table(spark, d, "token_csv").filter("raw is not null").select(F.col("file").alias("u"), F.col("raw").alias("line"))
    return M.import_lines(lines)[0].select("u", "token", "good", "spam")


def model_import_roundtrip(spark, d):
    tokens, _ = M.import_lines(model_export(spark, d))
    return tokens.select("u", "token", "good", "spam")


# --- scores


def _probs(spark, d, p=None):
    return S.with_probabilities(*trained(spark, d), p or ScoreParams())


def token_prob(spark, d):
    t, totals = stored(spark, d)
    z = F.lit(0)
    f = S.token_prob(F.col("good"), F.col("spam"), F.coalesce("total_good", z), F.coalesce("total_spam", z), ScoreParams())
    return t.join(totals, "u", "left").select("u", "token", F.round(f, 6).alias("f"))


def top_interesting(spark, d):
    p = ScoreParams(max_interesting=15)
    kept = S.select_interesting(_probs(spark, d, p), p)
    return kept.select("msg_id", "rn", "token", F.round("f", 6).alias("f"))


def min_distance_select(spark, d):
    p = ScoreParams(max_interesting=50, min_distance=0.2, min_array_size=3)
    return S.select_interesting(_probs(spark, d, p), p).groupBy("msg_id").agg(F.count(F.lit(1)).alias("kept"))


def _scores(spark, d, p):
    return S.classify(messages(spark, d), *trained(spark, d), p).select("msg_id", "u", "verdict", F.round("score", 6).alias("score"))


def score_fisher(spark, d):
    return _scores(spark, d, ScoreParams())


def score_geometric(spark, d):
    return _scores(spark, d, ScoreParams(combine_mode="geometric"))


def score_good_bias(spark, d):
    return _scores(spark, d, ScoreParams(good_bias=2.0, strength=0.5, unknown_prob=0.45, max_interesting=50))


def score_gated(spark, d):
    return _scores(spark, d, ScoreParams(min_word_count=2, new_word_score=0.4, max_interesting=27))


def explain_top_tokens(spark, d):
    e = S.explain(*trained(spark, d), ScoreParams()).filter("rn <= 40")
    return e.select("msg_id", "rn", "token", "good", "spam", F.round("f", 6).alias("f"))


def _judged(spark, d, p=None):
    s = _scores(spark, d, p or ScoreParams()).join(labels(spark, d), "msg_id")
    return s.select("msg_id", "u", "score", "is_spam", (F.col("verdict") == "SPAM").alias("pred_spam"))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


RATES = ("fp_rate", "fn_rate", "error_rate", "balanced_error", "weighted_error")


def confusion_matrix(spark, d):
    return _rounded(EV.rates(EV.confusion(_judged(spark, d)), 10.0), *RATES)


def folder_eval(spark, d):
    folders = table(spark, d, "documents").select(F.col("doc_id").alias("msg_id"), "folder")
    return EV.confusion(_judged(spark, d).join(folders, "msg_id"), "folder")


def score_percentiles(spark, d):
    return EV.nearest_rank(_judged(spark, d), "score", [0.01, 0.05, 0.5, 0.95, 0.99], "is_spam")


def score_histogram(spark, d):
    s = table(spark, d, "delivery_start").select("u", "verdict", F.col("score").try_cast("double").alias("score"))
    return EV.histogram(s, "score", "verdict")


def stratified_split(spark, d):
    return EV.stratified_split(labels(spark, d).select("msg_id", "is_spam"), "is_spam", "msg_id", 0.3)


def threshold_sweep(spark, d):
    """The score doesn't depend on the threshold: one scoring serves the whole grid."""
    t = F.explode(F.array(*(F.lit(x) for x in EV.GRIDS["threshold"]))).alias("threshold")
    s = _judged(spark, d).select("score", "is_spam", t)
    c = EV.confusion(s.withColumn("pred_spam", F.col("score") >= F.col("threshold")), "threshold")
    return _rounded(EV.rates(c), *RATES)


def params_grid(spark, d):
    """Every strength with every unknown probability, scored in one pass over the looked-up tokens."""
    t, model, totals = trained(spark, d)
    data = materialize(EV.samples(t, labels(spark, d), model), "samples")
    base = {k: getattr(ScoreParams(), k) for k in EV.KNOBS}
    grid = [(i * 10 + j, s, x) for i, s in enumerate(EV.GRIDS["strength"]) for j, x in enumerate(EV.GRIDS["unknown_prob"])]
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"), F.lit(x).alias("x")) for c, s, x in grid))).alias("g")
    cands = totals.select("u", one).select("u", F.col("g.c").alias("cand"), *(F.col("g.s").alias(k) if k == "strength" else F.col("g.x").alias(k) if k == "unknown_prob" else F.lit(base[k]).alias(k) for k in EV.KNOBS))
    got = EV._score_candidates(data, cands, totals)
    return got.groupBy("cand").agg(*(F.sum(c).alias(c) for c in ("fp", "fn", "tp", "tn")))


def tune_per_user(spark, d):
    t, model, totals = trained(spark, d)
    owned = labels(spark, d).join(messages(spark, d), "msg_id")
    split = EV.stratified_split(owned.select("u", "msg_id", "is_spam"), "is_spam", "msg_id", EV.HOLDOUT, "u")
    return EV.tune_gated(EV.samples(t, labels(spark, d), model), split, totals)


def _by_label(spark, d, p, name):
    return _scores(spark, d, p).select("msg_id", "u", F.col("verdict").alias(f"{name}_verdict"), F.col("score").alias(f"{name}_score"))


def _shadow(spark, d):
    """Both parameter sets score the same stored tokens."""
    t = materialize(tokens_of(spark, d), "tokens")
    m = M.train_tokens(t, labels(spark, d)), M.train_totals(messages(spark, d), labels(spark, d))

    def run(p, name):
        s = S.classify(messages(spark, d), t, *m, p)
        return s.select("msg_id", "u", F.col("verdict").alias(f"{name}_verdict"), F.round("score", 6).alias(f"{name}_score"))

    return run(ScoreParams(), "p").join(run(ScoreParams(strength=0.5, max_interesting=27, threshold=0.6), "c"), ["msg_id", "u"])


def shadow_compare(spark, d):
    return _rounded(R.shadow_per_user(_shadow(spark, d)), "delta_p50", "delta_p99")


def shadow_ordered(spark, d):
    """The owners whose two scorings differ most."""
    return R.most_divergent(R.shadow_per_user(_shadow(spark, d))).select("rank", "u", "n", "disagree")


def shadow_totals(spark, d):
    return R.shadow_totals(_shadow(spark, d))


def fail_open(spark, d):
    s = table(spark, d, "delivery_start").select("row_id", F.upper("verdict").alias("verdict"), F.col("score").try_cast("double").alias("score"))
    v, x = S.fail_open(F.col("verdict"), F.col("score"))
    return s.select("row_id", v.alias("v"), x.alias("s"), S.verdict_line(v, x).alias("line"))


def rail_score(spark, d):
    """Messages of the logs by the suffix of their Message-Id: the verdicts train, the rail floors."""
    keyed = with_references(table(spark, d, "msgid_line").select("row_id", "u", "session", "msgid"), {"s": "session"}, {"k": "msgid"}).filter("k is not null and s is not null and u is not null")
    verdicts = with_references(table(spark, d, "delivery_start").select("session", "verdict"), {"s": "session"}).filter("s is not null and verdict is not null")
    v = verdicts.groupBy("s").agg(F.max((F.upper("verdict") == "SPAM").cast("int")).alias("spam"))
    host = F.substring_index("k", "@", -1)
    m = keyed.join(v, "s").select("u", F.col("row_id").alias("msg_id"), "spam", host.alias("host"))
    toks = F.array_compact(F.array(F.concat(F.lit("x:tld:"), T.effective_tld(F.col("host"))), F.concat(F.lit("h:from:"), F.col("host"))))
    t = m.select("u", "msg_id", F.explode(F.array_distinct(toks)).alias("token"))
    lab = m.select("msg_id", (F.col("spam") == 1).alias("is_spam"), F.lit(None).cast("timestamp").alias("at"))
    p = ScoreParams(rail=True, rail_min_spam=2, rail_strong_spam=5, rail_require_coflag=True)
    return S.classify(m.select("u", "msg_id"), t, M.train_tokens(t, lab), M.train_totals(m, lab), p).withColumn("score", F.round("score", 6))


# --- logs


def _events(spark, d):
    return E.parse_lines(table(spark, d, "mail_log"))


def log_parse(spark, d):
    return _events(spark, d)


def _pairs(spark, d):
    """The records of both tables as events of one log per owner, in order of their batches."""
    at = lambda kind: (F.col("batch_id").cast("bigint") * 2 + kind) * 1_000_000_000 + F.col("row_id")
    ds = with_references(table(spark, d, "delivery_start"), {"sess": "session"})
    ml = with_references(table(spark, d, "msgid_line"), {"sess": "session"})
    no = F.lit(None).cast("string")
    a = ds.select(F.col("u").alias("file"), at(0).alias("line_no"), F.lit("D").alias("kind"), "sess", F.col("ts").alias("t"), "u", "verdict", "score", "folder", no.alias("msgid"))
    b = ml.select(F.col("u").alias("file"), at(1).alias("line_no"), F.lit("M").alias("kind"), "sess", no.alias("t"), "u", no.alias("verdict"), no.alias("score"), no.alias("folder"), "msgid")
    return a.unionByName(b).filter("sess is not null and u is not null")


def session_stitch(spark, d):
    return E.stitch(_pairs(spark, d))


def session_orphans(spark, d):
    return E.stitch(_pairs(spark, d)).filter("msgid is null").select("file", "line_no", "sess", "u")


def train_events_by_user(spark, d):
    return E.train_summary(_events(spark, d))


def events_by_date(spark, d):
    return E.by_date(table(spark, d, "delivery_start"), "ts")


def top_users(spark, d):
    return E.top_users(table(spark, d, "delivery_start").filter("u is not null"))


def harvest_totals(spark, d):
    return E.harvest_totals(session_stitch(spark, d))


def _deliveries(spark, d):
    """Deliveries with the message ids of their sessions."""
    ds = with_references(table(spark, d, "delivery_start").select("row_id", "session", "verdict", "score", "folder"), {"s": "session"}).filter("s is not null")
    one = ds.groupBy("s").agg(F.max_by(F.struct("verdict", "score", "folder"), "row_id").alias("d"), F.max("row_id").alias("seq"))
    ml = with_references(table(spark, d, "msgid_line").select("u", "session", "msgid"), {"s": "session"}, {"k": "msgid"}).filter("s is not null and k is not null")
    return ml.select("u", "s", F.col("k").alias("msgid")).join(one, "s").select("u", "msgid", F.upper("d.verdict").alias("verdict"), F.col("d.score").alias("score"), F.col("d.folder").alias("folder"), "seq")


def _files(spark, d):
    return with_references(table(spark, d, "mailbox_file").select("file_id", "u", "folder", F.col("msgid").alias("raw")), msgids={"msgid": "raw"}).drop("raw")


def correlate_labels(spark, d):
    return E.correlate(_files(spark, d), _deliveries(spark, d))


def correlate_bands(spark, d):
    c = correlate_labels(spark, d)
    return c.groupBy("label", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("algo_error").alias("algo_errors"))


def correlate_unmatched(spark, d):
    return E.unmatched(_files(spark, d), _deliveries(spark, d))


def _nightly(spark, d):
    s = table(spark, d, "delivery_start").filter(~F.isnan(F.col("score").try_cast("double"))).select("u", F.col("loaded_at").cast("date").cast("string").alias("d"), F.upper("verdict").alias("verdict"), F.col("score").try_cast("double").alias("score"), F.col("folder").startswith("Junk").alias("junk"))
    return R.nightly(s.filter("u is not null and d is not null and junk is not null"))


def nightly_stats(spark, d):
    n = _nightly(spark, d)
    return n.select("u", "d", F.array_join(F.col("in").cast("array<string>"), ",").alias("in_cells"), F.array_join(F.col("jk").cast("array<string>"), ",").alias("jk_cells"), "fn", "fp")


def latest_per_user(spark, d):
    return R.latest(_nightly(spark, d).select("u", "d", "fn", "fp"), ["d"], "u")


def _users(spark, d):
    return latest_per_user(spark, d).join(table(spark, d, "model_totals").select("u", F.col("total_good").alias("good"), F.col("total_spam").alias("spam")), "u")


def _corrected(spark, d):
    """Owners with the corrections of all their messages and the size of their model."""
    c = correlate_labels(spark, d).groupBy("u").agg(F.count_if(F.col("label") == "fn").alias("fn"), F.count_if(F.col("label") == "fp").alias("fp"))
    return c.join(table(spark, d, "model_totals").select("u", F.col("total_good").alias("good"), F.col("total_spam").alias("spam")), "u")


def cluster_digest(spark, d):
    return R.cluster_totals(_users(spark, d))


def digest_top_missed(spark, d):
    return R.top_missed(_corrected(spark, d))


def digest_false_positives(spark, d):
    return R.with_false_positives(_corrected(spark, d))


def digest_candidates(spark, d):
    return R.threshold_candidates(_corrected(spark, d))


def allowlist_semi(spark, d):
    allow = table(spark, d, "model_totals").filter("total_good > total_spam").select(F.upper("u").alias("entry"))
    return R.allowed(table(spark, d, "delivery_start").select("row_id", "u"), allow)


def allowlist_all(spark, d):
    """A list with ``*`` among its entries allows every row."""
    allow = table(spark, d, "model_totals").select(F.when(F.col("total_good") > F.col("total_spam"), F.col("u")).otherwise("*").alias("entry"))
    return R.allowed(table(spark, d, "delivery_start").select("row_id", "u"), allow)


def tune_skipped(spark, d):
    """Owners whose stored model has too few messages to tune by, and the others."""
    t = table(spark, d, "model_totals")
    return EV.tunable(t).select("u", "skipped")


def limit_per_folder(spark, d):
    f = table(spark, d, "mailbox_file").select("u", "folder", "path", "file_id")
    return EV.limit_per(f, 5, "path", "u", "folder").select("u", "folder", "path")


# --- order-dependent and streaming


def receive_replay(spark, d):
    from quillsift.streaming.learn import replay

    docs = documents(spark, d).select("u", F.col("doc_id").alias("msg_id"), F.col("received_at").alias("at"), TK.body_tokens(F.col("text")).alias("tokens"))
    src = docs.join(labels(spark, d).select("msg_id", "is_spam"), "msg_id", "left").filter("u is not null")
    return replay(src).withColumn("score", F.round("score", 6))


def convergence_train(spark, d):
    from quillsift.streaming.learn import replay

    docs = documents(spark, d).select("u", F.col("doc_id").alias("msg_id"), F.col("received_at").alias("at"), TK.body_tokens(F.col("text")).alias("tokens"))
    src = docs.join(labels(spark, d).select("msg_id", "is_spam"), "msg_id").filter("u is not null")
    return replay(src, ScoreParams(train_max_reps=5, combine_mode="geometric")).withColumn("score", F.round("score", 6))


def _stream(spark, df, name):
    """A bounded table as a stream: written to the shared folder and read as files."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(spark, stream, name):
    """Run a stream to its end; the result is a table in the shared folder."""
    out = scratch_path(spark, name)

    def write(batch, _):
        batch.write.mode("append").parquet(out)

    q = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", scratch_path(spark, name + "-checkpoint")).trigger(availableNow=True).start()
    if not q.awaitTermination(1800):
        q.stop()
        raise TimeoutError(name)
    return spark.read.schema(stream.schema).parquet(out)


def stream_session_stitch(spark, d):
    from quillsift.streaming.stitch import PROVIDER, stitch_stream

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        out = _run(spark, stitch_stream(_stream(spark, _pairs(spark, d), "events"), timers=False), "stitched")
    finally:
        spark.conf.set(key, before)
    return out.filter("msgid is not null")


def stream_daily_counts(spark, d):
    from quillsift.streaming.stitch import daily_counts

    src = table(spark, d, "delivery_start").select("loaded_at", "verdict").filter("verdict is not null and loaded_at is not null")
    # days are given out once they are final and their state is dropped; an event of a later day closes the last one
    end = src.agg((F.max("loaded_at") + F.expr("INTERVAL 3 DAYS")).alias("loaded_at"), F.lit(None).cast("string").alias("verdict")).filter("loaded_at is not null")
    out = _run(spark, daily_counts(_stream(spark, src.unionByName(end), "deliveries"), "loaded_at", "verdict"), "daily")
    return out.filter("verdict is not null").select(F.col("d").cast("string").alias("d"), "verdict", "n")


NAMES = """tokenize_body subject_unigrams subject_bigrams token_doc_freq url_normalize host_decompose effective_tld
email_address_tokens homoglyph_fold mixed_script_flag brand_mismatch auth_tokens html_to_tokens train_model model_totals
model_counts_by_user model_merge model_cleanup model_export model_import model_import_roundtrip token_prob top_interesting
min_distance_select score_fisher score_geometric score_good_bias score_gated explain_top_tokens confusion_matrix folder_eval
score_percentiles score_histogram stratified_split threshold_sweep params_grid tune_per_user shadow_compare shadow_totals
fail_open rail_score log_parse session_stitch session_orphans train_events_by_user events_by_date top_users harvest_totals
correlate_labels correlate_bands correlate_unmatched nightly_stats latest_per_user cluster_digest digest_top_missed
digest_candidates digest_false_positives allowlist_semi allowlist_all tune_skipped mime_tokens shadow_ordered limit_per_folder receive_replay convergence_train stream_session_stitch
stream_daily_counts""".split()
QUERIES = {n: globals()[n] for n in NAMES}

from quillsift.plans.mail_sql import SQL  # noqa: E402, F401
