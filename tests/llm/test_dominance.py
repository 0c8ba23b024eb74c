"""The quicker test of dominance in packing says what looking at every length says."""

import random

from spatialseg.llm import packing


def plain(chosen, lengths, counts, slack):
    used = dict(chosen)
    items = [n for n, k in chosen for _ in range(min(k, 2))]
    sums = {(n, n + slack) for n in items if slack} | {(a + b, a + b + slack) for i, a in enumerate(items) for b in items[i + 1 :]}
    return any((lo < y or lo not in items and y == lo) and y <= hi and counts[y] > used.get(y, 0) for lo, hi in sums for y in lengths)


def test_dominated():
    rng, said = random.Random(7), []
    for _ in range(3000):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 60), rng.randrange(1, 12))}
        lengths = sorted(counts, reverse=True)
        chosen = tuple((n, rng.randrange(1, counts[n] + 1)) for n in lengths if rng.random() < 0.4)
        slack = rng.randrange(6)
        said.append(packing.dominated(chosen, lengths, counts, slack))
        assert said[-1] == plain(chosen, lengths, counts, slack)
    assert 300 < sum(said) < 2700


def test_dominance_looks_at_no_length_twice():
    """Work of a test follows the sums of the chosen, not the number of lengths."""
    asked = []

    class Counted(dict):
        def get(self, y, default=None):
            asked.append(y)
            return super().get(y, default)

        def __getitem__(self, y):
            asked.append(y)
            return super().__getitem__(y)

    counts = Counted({n: 1 for n in range(1, 1024, 2)})
    packing.dominated(((501, 1), (321, 1)), sorted(counts, reverse=True), counts, 0)
    assert len(asked) <= 2
