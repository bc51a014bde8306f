"""The near copies of the pipeline: what is found and what is shuffled."""

import numpy as np
import pytest

pytest.importorskip("kgspark.llm")

from kgspark.llm import simhash  # noqa: E402


def _shuffled(spark, work):
    """Bytes that the stages of work() write for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = sc._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (x for x in _list(jobs.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())))}
    before = stages()
    work()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_shuffle_grows_with_the_rows_not_with_their_square(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 24))) for i in range(3200)]
    run = lambda n: _shuffled(spark, lambda: simhash.similar_groups(spark.createDataFrame(rows[:n], "doc_id long, text string"), tile_rows=32).count())
    small, large = run(800), run(3200)
    assert 0 < large < 6 * small


def test_short_texts_at_the_threshold_are_linked(spark):
    # nine words and the first eight of them: four of five shingles in common
    rows = []
    for i in range(400):
        words = [f"p{i}x{j}" for j in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_clusters_of_unlike_rows_are_cut_at_the_threshold(spark, tile_rows):
    # two groups of near copies and stray rows that share a half with both: whatever meets, only 0.8 links
    base = [f"b{j}" for j in range(60)]
    texts = [base[:50] + [f"e{i}{j}" for j in range(2)] for i in range(20)] + [base[30:] + [f"f{j}" for j in range(30)] + [f"g{i}"] for i in range(20)] + [base[:25] + [f"h{i}{j}" for j in range(20)] for i in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile_rows=tile_rows).collect()}
    assert got == dict(enumerate(part)) and len(set(part)) == 12
