from collections import defaultdict

import pytest

from quillsift.llm import packing

TEXTS = [(i, f"topic{i % 7} " + "lorem ipsum dolor sit amet " * (i % 23 + 1)) for i in range(300)]
TEXTS += [(1000, None), (1001, ""), (1002, "   "), (1003, "long text about nothing " * 3000), (1004, TEXTS[5][1]), (1005, "<|endoftext|> ok")]


@pytest.mark.parametrize("shard", [3000, 20])
def test_pack(spark, shard):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id bigint, text string, kind string, capacity int")
    kinds = spark.createDataFrame([("s", 256), ("l", 1024), ("bad", None), ("zero", 0)], "kind string, capacity int")
    rows = packing.pack(docs, kinds, shard_docs=shard).collect()
    enc = packing.encoder(packing.default_tokenizer())
    size = {i: len(enc.encode_ordinary(t)) for i, t in TEXTS if t}
    boxes, docs_ = defaultdict(int), defaultdict(list)
    for r in rows:
        boxes[r.kind, r.container] += r.n_tokens
        docs_[r.kind, r.doc_id].append((r.first_token, r.n_tokens))
    for kind, cap in (("s", 256), ("l", 1024)):
        assert {d for k, d in docs_ if k == kind} == set(size)
        for d, n in size.items():
            parts = sorted(docs_[kind, d])
            assert sum(n for _, n in parts) == n and (len(parts) == 1 or n > cap)
            assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        mine = [v for (k, _), v in boxes.items() if k == kind]
        assert max(mine) <= cap and sum(mine) / (cap * len(mine)) > 0.9
    assert {r.kind for r in rows} == {"s", "l"}
    assert packing.pack(docs.limit(0), kinds).count() == 0


def test_neighbours_go_together():
    import numpy as np

    terms = [np.array([i % 3], np.int32) for i in range(30)]
    boxes = packing.fill(np.full(30, 10), terms, [np.ones(1, np.float32)] * 30, 100)
    assert len(boxes) == 3 and all(len({i % 3 for i in b}) == 1 for b in boxes)


def test_all_terms_of_a_seed_ask():
    """A neighbour that shares only the seed's lightest terms goes before one that shares none, whatever its place."""
    import numpy as np

    seed = np.arange(40, dtype=np.int32)
    for shared in (39, 20):
        terms = [seed, *(np.array([100 + i], np.int32) for i in range(20)), np.array([shared], np.int32)]
        weights = [np.linspace(9, 1, 40, dtype=np.float32), *([np.ones(1, np.float32)] * 21)]
        boxes = packing.fill(np.array([50, *[10] * 21]), terms, weights, 60)
        assert sorted(next(b for b in boxes if 0 in b)) == [0, 21]


def test_scores_are_whole():
    """Neighbours come in the order of the sum of the weights over all shared terms, common and rare ones."""
    import numpy as np

    rng = np.random.default_rng(3)
    terms = [np.sort(rng.choice(200, 60, replace=False, p=(w := 1 / np.arange(1, 201)) / w.sum())).astype(np.int32) for _ in range(80)]
    weights = [rng.random(60).astype(np.float32) for _ in range(80)]
    sizes = np.array([100, *[10] * 79])
    box = packing.fill(sizes, terms, weights, 300)[0]
    score = [w[np.isin(t, terms[0])].sum() for t, w in zip(terms[1:], weights[1:])]
    assert box == [0, *(1 + np.argsort(-np.array(score), kind="stable")[:20])]
