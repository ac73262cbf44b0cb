"""Groups of seeds that can't make up a template are left out, which loses no span and takes little time."""

from __future__ import annotations

import random
import time

from lodestone.llm import licenses


def test_groups_lose_no_span():
    rnd, scanner = random.Random(2), licenses.Scanner()
    plain = licenses.Scanner()
    plain._promising = lambda t, seeds: [seeds]
    bodies = [t.split() for t in licenses.TEMPLATES.values()]
    some = 0
    for _ in range(150):
        text = []
        for _ in range(rnd.randrange(1, 6)):
            own = rnd.choice(bodies)
            a = rnd.randrange(len(own))
            text += own[a : a + rnd.randrange(1, 60)] if rnd.random() < 0.5 else own
            text += ["filler"] * rnd.randrange(12)
        got, want = scanner.scan(" ".join(text)), plain.scan(" ".join(text))
        assert got[:2] == want[:2] and sorted(got[2]) == sorted(want[2])
        some += len(got[2])
    assert some > 100


def test_repeated_words_of_licences_take_linear_time():
    scanner = licenses.Scanner()
    scanner.scan("the software " * 100)
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        _, places, spans = scanner.scan("the software " * n)
        took.append(time.perf_counter() - began)
        assert not places and not spans
    assert took[1] < 8 * took[0] + 1
    print(took)
