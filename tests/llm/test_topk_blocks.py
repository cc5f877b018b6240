"""Exact top-k over many small blocks of rows and queries equals a plain sort of all scores."""

import random

from ragchew.llm import topk


def test_many_blocks_and_cells(spark):
    pick = random.Random(5)
    rows = [(i % 290, [pick.randint(-3, 3) for _ in range(3)]) for i in range(300)]  # ties and repeated ids
    rows += [(i, [pick.randint(-9, 9)] * 2) for i in range(300, 340)] + [(400, []), (401, [])]  # other lengths
    asked = [(i, v) for i, v in rows if i % 7 == 0]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("id % 7 = 0"), k=4, bits=4, block=16, query_block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = {}
    for i, v in {(i, tuple(v)) for i, v in asked}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if len(w) == len(v) and j != i)
        want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(scored[:4]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}
