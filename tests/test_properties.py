"""Laws that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.functions import codec, distance
from wordloom.plans.request import SearchRequest
from wordloom.sources.readers import main_text_of

WORD = st.text("abc", max_size=6)


@given(st.lists(st.integers(0, 1 << 40)))
def test_code_round_trip(numbers):
    assert codec.decode(codec.encode(numbers)) == numbers


@settings(max_examples=300)
@given(WORD, WORD, WORD)
def test_distance_is_a_metric(a, b, c):
    d = distance.damerau_levenshtein
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert d(a, b) <= distance.optimal_alignment(a, b) <= 2 * max(d(a, b), 1)


def left_out(word, most):
    out = {word}
    for _ in range(most):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


@settings(max_examples=500)
@given(WORD, WORD, st.integers(1, 2))
def test_blocking_misses_nothing(a, b, most):
    if distance.damerau_levenshtein(a, b) <= most:
        assert left_out(a, most) & left_out(b, most)


@given(st.text(), st.integers(-5, 50))
def test_requests_never_fail(query, num):
    from urllib.parse import quote

    got = SearchRequest.parse(f"query={quote(query)}&NUM={num}&ranker=COSINE&format=odd&checker=bk")
    assert got.query == query and got.num == (num if num >= 0 else 10) and (got.ranker, got.format, got.checker) == ("cosine", "text", "bk")


@given(st.text())
def test_main_text_never_fails(html):
    main_text_of(html)
