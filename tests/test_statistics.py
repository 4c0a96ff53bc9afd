import math

import pytest

from strandloom.config import Config
from strandloom.functions import statistics as st


def test_distance_and_jaccard_invert_each_other():
    for model in ("poisson", "binomial"):
        for j in (0.01, 0.12, 0.5, 0.9):
            assert math.isclose(st.distance_to_jaccard(st.jaccard_to_distance(j, 16, model), 16, model), j, rel_tol=1e-12)
    assert st.jaccard_to_distance(0.12, 16, "binomial") < st.jaccard_to_distance(0.12, 16)
    assert st.jaccard_to_distance(0, 16) == 1 and st.jaccard_to_distance(1, 16) == 0


def test_distance_rows():
    rows = st.distance_rows(100, 16)
    assert rows[0][1] == 0 and rows[100][1:] == (100, 100)
    assert rows[50][1] == pytest.approx(97.465843, abs=1e-6) and rows[50][2] == pytest.approx(98.06872, abs=1e-5)


@pytest.mark.parametrize("identity,window,sketch", [(70, 4, 1220), (78, 17, 340), (80, 24, 250), (82.5, 37, 160), (90, 200, 30)])
def test_recommended_sizes(identity, window, sketch):
    assert st.recommended_window(1e-3, 16, identity, 3000, 5_000_000) == window
    assert st.recommended_minmer_sketch(1e-3, 16, identity, 3000, 5_000_000) == sketch


def test_minimum_hits():
    assert [st.minimum_hits(s, 16, 80) for s in (100, 257, 375)] == [3, 6, 8]
    assert [st.relaxed_minimum_hits(s, 16, 80) for s in (100, 257, 375)] == [1, 3, 4]


def test_odd_span_window():
    assert [st.odd_span_window(k, w) for k, w in ((16, 17), (15, 16), (16, 1))] == [16, 15, 2]
    assert Config(min_identity=78, mode="exact").resolved_window() == 17
    assert Config(min_identity=78).resolved_window() == 16


@pytest.mark.parametrize("wrong", [{"kmer": 0}, {"kmer": 33}, {"fragment": 16}, {"min_identity": 101}, {"min_fraction": 2}, {"ignore_top_percent": -1}, {"diagonal_bin": 0}, {"mode": "x"}, {"model": "x"}, {"window": 2990}])
def test_config_names_what_is_wrong(wrong):
    with pytest.raises(ValueError):
        Config(**wrong).checked()
