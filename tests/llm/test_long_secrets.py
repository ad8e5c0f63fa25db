"""Secrets of any length are candidates, in time linear in the text."""

import time

from sparkcurate.llm import pii


def secrets(text):
    return [(a, b) for kind, a, b, *_ in pii.candidates(text, []) if kind == "secret"]


def test_secrets_of_any_length():
    for n in (19, 20, 200, 201, 204, 5000):
        value = ("aB3dE6gH1" * 600)[:n]
        assert secrets(f"token = {value} end") == ([(8, 8 + n)] if n >= 20 else [])
        assert secrets(f"token = {'x' * (n - 1)}7 end") == ([(8, 8 + n)] if n >= 20 else [])
        assert secrets(f"token = {'x' * n} 7") == []


def test_long_runs_take_linear_time():
    began = time.time()
    assert secrets("x" * 2_000_000 + " 7") == []
    assert secrets("x" * 2_000_000 + "7") == [(0, 2_000_001)]
    assert time.time() - began < 20


def test_many_spans_in_one_text():
    """Time in proportion to the spans, and none that reaches into another, however far apart their starts are."""
    import time

    from sparkcurate.llm import pii

    def spans(n):
        text = " ".join(f"a{i}@b.com 2001:db8:0:0:0:0:0:{i % 9000:x} (030) 1234-{i % 9000:04d}" for i in range(n))
        start = time.perf_counter()
        base = pii.base_spans(text)
        found = [(a, b) for _, a, b, _, _ in pii.candidates(text, base)]
        return time.perf_counter() - start, base, found

    small, _, _ = spans(2000)
    large, base, found = spans(16000)
    assert large < 24 * small + 0.5
    assert len(found) >= 16000
    edges = sorted([(a, b) for _, a, b in base] + found)
    assert all(b <= c for (_, b), (c, _) in zip(edges, edges[1:]))


def test_overlaps_with_far_earlier_spans():
    from sparkcurate.llm.pii import _disjoint

    assert _disjoint([(50, 60), (0, 100), (10, 11), (200, 201), (201, 205)]) == ([0, 200, 201], [100, 201, 205])
