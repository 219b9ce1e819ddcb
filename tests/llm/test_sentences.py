import pytest
from pyspark.sql import functions as F

from quillsift.llm import sentences as S

CASES = [
    ("The cat sat. The dog ran at 5.39 p.m. near the gate. It rained!", ["The cat sat.", "The dog ran at 5.39 p.m. near the gate.", "It rained!"]),
    ("Dear Mr. and Mrs. Berisen,\n\nWe met Dr. Hovir at 5 p.m. The talk was long.", ["Dear Mr. and Mrs. Berisen,", "We met Dr. Hovir at 5 p.m.", "The talk was long."]),
    ('"Who left?" asked Ann as usual. Then we went.', ['"Who left?" asked Ann as usual.', "Then we went."]),
    ("He said: “We lost it?” After that we slept.", ["He said: “We lost it?”", "After that we slept."]),
    ("It broke. (The gate was open.) The man left.", ["It broke.", "(The gate was open.)", "The man left."]),
    ("It broke (who cares?) after lunch. We left.", ["It broke (who cares?) after lunch.", "We left."]),
    ("We waited... then nothing came. The end.", ["We waited... then nothing came.", "The end."]),
    ("1. The seat booking\n\n2) The keys", ["1. The seat booking", "2) The keys"]),
    ("> The first line\n> goes on. The second\n> ends.\n\nBye", ["The first line\n> goes on.", "The second\n> ends.", "Bye"]),
    ("It went to the server.A man came. The end.", ["It went to the server.", "A man came.", "The end."]),
    ("Le relais a vu le mail ! La porte, p. ex. la clé, est là ? « Oui. »", ["Le relais a vu le mail !", "La porte, p. ex. la clé, est là ?", "« Oui. »"]),
    ("Der Chor kam am 2. Mai an. Die Hotline, z. B. der Rest, ging mit ca. 9,3 MB.", ["Der Chor kam am 2. Mai an.", "Die Hotline, z. B. der Rest, ging mit ca. 9,3 MB."]),
    ("合唱团重启之后拦截了收据。“谁看到了？”收件人问道。我们使用in1.retar.test退回了附件！", ["合唱团重启之后拦截了收据。", "“谁看到了？”收件人问道。", "我们使用in1.retar.test退回了附件！"]),
    ("「開きました。」と言いました。管理人は止めました（見ていません。）ので困りました。", ["「開きました。」と言いました。", "管理人は止めました（見ていません。）ので困りました。"]),
    ("यह समाचार है । डॉ. गायन मंडली खो चुका है। सं. 68 के अनुसार है।", ["यह समाचार है ।", "डॉ. गायन मंडली खो चुका है।", "सं. 68 के अनुसार है।"]),
    ("นักอ่านเก็บรายการจำนวน 55 รายการค่ะ ผู้ดูแลลบรายการ", ["นักอ่านเก็บรายการจำนวน 55 รายการค่ะ", "ผู้ดูแลลบรายการ"]),
    ("نسخ ناقل الطرود العقد. د. مكتب السفر حفظ العقد؟ قال: «نعم.»", ["نسخ ناقل الطرود العقد.", "د. مكتب السفر حفظ العقد؟", "قال: «نعم.»"]),
    ("no stop here\r\n \t\r\nnext block", ["no stop here", "next block"]),
    ('An open "quote goes on. And then some.', ['An open "quote goes on.', "And then some."]),
    ("We met Supt. Hovir at noon. Then we left.", ["We met Supt. Hovir at noon.", "Then we left."]),
    ("Siehe Abschn. 4 im Text. Der Rest folgt.", ["Siehe Abschn. 4 im Text.", "Der Rest folgt."]),
    (
        "The courier notice delayed the exam results since Tuesday The help desk read the member list once more The night relay lost a voucher",
        ["The courier notice delayed the exam results since Tuesday", "The help desk read the member list once more", "The night relay lost a voucher"],
    ),
    ("  > A quoted line opens here.\n  > It ends there.", ["A quoted line opens here.", "It ends there."]),
    ("The help desk read the list by\r\nmistake. The relay lost it.\r\n\r\nBye", ["The help desk read the list by\r\nmistake.", "The relay lost it.", "Bye"]),
    ("“合唱团丢失了会议记录？”我们的队列问道。「开了。」と経理の担当者は言いました。", ["“合唱团丢失了会议记录？”我们的队列问道。", "「开了。」と経理の担当者は言いました。"]),
    (None, []), ("", []), ("  \n\t ", []), (".", ["."]), ("...", ["..."]),
]


@pytest.fixture(scope="module")
def model(spark, data):
    return S.train(S.scanned(spark.read.parquet(f"{data}/documents.parquet".replace("sf0.001", "sf0.01"))))


@pytest.mark.parametrize("text,want", CASES)
def test_cases(model, text, want):
    got = [text[a:b] for a, b in model.units(text)] if text else []
    assert got == want


def test_positions(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).withColumn("start_pos", F.lit("x"))
    text = dict(docs.select("doc_id", "text").collect())
    rows = S.sentences(docs).collect()
    seen: dict = {}
    for r in rows:
        t = text[r.doc_id][r.start_pos : r.end_pos]
        assert t and t == t.strip()
        seen.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for d, us in seen.items():
        us = sorted(set(us))
        assert all(a[1] <= b[0] for a, b in zip(us, us[1:]))
        covered = "".join(text[d][a:b] for a, b in us)
        assert sum(c.isalnum() for c in covered) == sum(c.isalnum() for c in text[d])
    assert set(seen) == {d for d, t in text.items() if t and t.strip()}


def test_empty_and_long(spark, model):
    e = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.sentences(e).count() == 0
    assert len(model.units("The cat sat. " * 20_000)) == 20_000
    assert len(model.units("x" * 200_000)) == 1


def test_abbreviations_are_learned(spark):
    """A made-up abbreviation is cut behind until the corpus shows how it is used; no list knows it."""
    names = ["Hovir", "Merol", "Tasim", "Konu", "Vibun", "Sape"]
    talk = [f"The {a} left early. Our {b} came late. A {a} read it. This {b} said so." for a in ("clerk", "relay", "choir", "desk", "filter") for b in ("note", "plan", "voucher", "queue")]
    titled = [f"We asked Zbrg. {n} about the {a}. The {a} was lost." for n in names for a in ("clerk", "relay", "choir", "desk", "filter")]
    docs = spark.createDataFrame(list(enumerate(talk * 3 + titled * 2)), "doc_id bigint, text string")
    m = S.train(S.scanned(docs))
    text = "We asked Zbrg. Merol about the desk. The desk was lost."
    assert [text[a:b] for a, b in m.units(text)] == ["We asked Zbrg. Merol about the desk.", "The desk was lost."]


def test_forward_backward(spark, model):
    """Posteriors of a run equal the sum over all its ways of being cut."""
    from itertools import product

    text = "He went to St. Fr. Dr. M. Xatim. The end."
    runs = [r for r in S.scan(text)[4] if r.count(S.GAP) > 1]
    assert runs
    for run in runs:
        gaps = [model.gap(g) for g in run.removeprefix("^").split(S.GAP)]
        total, yes = 0.0, [0.0] * len(gaps)
        for way in product((True, False), repeat=len(gaps)):
            p, before = 1.0, "^" if run[0] == "^" else ""
            for g, cut in zip(gaps, way):
                p *= model.weights(before, g)[0 if cut else 1]
                before = "^" if cut else ""
            total += p
            yes = [y + p * c for y, c in zip(yes, way)]
        got = [sum(y for _, _, y, _ in cells) for cells in model.posteriors(run)]
        assert got == pytest.approx([y / total for y in yes], abs=1e-9)
