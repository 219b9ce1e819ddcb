"""The registered queries against their SQL, over the smallest tables."""

import pytest

import __spark_entry__ as entry

from .compare import compare, duck

#: Queries whose runs are long even on small tables have tests of their own, and are compared at sf0.01 by the driver.
SAMPLE = """tokenize_body subject_bigrams host_decompose brand_mismatch train_model model_export score_fisher score_geometric
confusion_matrix stratified_split session_stitch correlate_labels nightly_stats p2_found p3_found p4_found p5_found""".split()


def test_registered():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    for n in range(2, 6):
        assert any(k.startswith(f"p{n}_") for k in q)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, data, name):
    ok, text = compare(spark, duck(data), data, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["msg_id", "u", "verdict", "score"]


def test_streams(spark, data):
    from quillsift.plans import mail

    assert compare(spark, duck(data), data, "stream_daily_counts", mail.stream_daily_counts, entry.oracle_sql()["stream_daily_counts"])[0]
    assert compare(spark, duck(data), data, "stream_session_stitch", mail.stream_session_stitch, entry.oracle_sql()["stream_session_stitch"])[0]


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quillsift"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillsift.llm" not in p.read_text()
