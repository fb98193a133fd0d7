"""op8 and the pipeline's first stage: counts and model in blocks of a bounded size."""

import random
import tracemalloc

import numpy as np

from corpusloom.llm import toxicity as X


def texts():
    rng = random.Random(3)
    return [" ".join(rng.choice(["all", "rights", "grobnik", "x%d" % rng.randint(0, 999)]) for _ in range(rng.randint(0, 80))).encode() for _ in range(60)]


def counted(some):
    counts = X.Counts()
    for i, text in some:
        counts.add(text, i % 2)
    return counts


def test_blocks_of_tasks_add_up_to_the_counts_of_all():
    every = list(enumerate(texts()))
    one, two, whole, met = counted(every[:25]), counted(every[25:]), counted(every), X.Counts()
    for i in range(len(X.BLOCKS)):
        x, y = (X.unpacked(X.packed(c.block(i))) for c in (one, two))
        met.put(i, np.concatenate([x[:2] + y[:2], np.maximum(x[2:], y[2:])]))
    for order in X.ORDERS:
        for a, b in ((met.n, whole.n), (met.context, whole.context), (met.suffix, whole.suffix)):
            assert np.array_equal(a[order], b[order])


def test_counts_leave_and_become_a_model_in_bounded_memory():
    counts = counted(enumerate(texts()))
    tracemalloc.start()
    try:
        for i in range(len(X.BLOCKS)):
            X.packed(counts.block(i))
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
        tracemalloc.reset_peak()
        model = X.Model(counts)
        assert tracemalloc.get_traced_memory()[1] < 80 << 20  # the tables are 17 MB
    finally:
        tracemalloc.stop()
    # one n-gram by hand: its discounted share of its context, and what the context gives away
    order = X.ORDERS[-1]
    n, context = counts.n[order][1], counts.context[order]
    at = int(np.flatnonzero(n > 1)[0])
    same = (context == context[at]) & (n > 0)
    keep, back = model.tables[order][1]
    assert np.isclose(keep[at] / X.HALF, (n[at] - X.DISCOUNT) / n[same].sum(), rtol=1e-3)
    assert np.isclose(back[context[at]] / X.HALF, X.DISCOUNT * same.sum() / n[same].sum(), rtol=1e-3)
