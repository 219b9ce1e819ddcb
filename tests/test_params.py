import pytest

from quillsift.params import GATE, ScoreParams, TokenizerConfig, read_params, resolve_threshold, write_params


def test_defaults():
    p = ScoreParams()
    assert (p.strength, p.unknown_prob, p.max_interesting, p.threshold, p.rail_floor, GATE) == (1.0, 0.5, 150, 0.5, 0.95, 0.2)


def test_read_refuses_out_of_range():
    seen = []
    p = read_params("strength = 0.5 # note\nthreshold = 1.5\nmax_interesting = 0\ngood_bias = 0\nnope = 1\nrubbish\ncombine_mode = geo\nrail = yes\n", warn=seen.append)
    assert p == ScoreParams(strength=0.5, combine_mode="geometric", rail=True)
    assert len(seen) == 5


@pytest.mark.parametrize("line,field,value", [("rail_min_spam = 3", "rail_min_spam", 3), ("rail_floor = 0.4", "rail_floor", 0.95), ("train_max_reps = 26", "train_max_reps", 1), ("rail_require_coflag = off", "rail_require_coflag", False)])
def test_read_values(line, field, value):
    assert getattr(read_params(line, warn=lambda m: None), field) == value


def test_write_keeps_other_lines():
    text = "# why\ncombine_mode = geometric\nthreshold = 0.7 # old\n\ntrain_max_reps = 5\n"
    out = write_params(text, ScoreParams(threshold=0.6, max_interesting=27))
    assert out.startswith("# why\ncombine_mode = geometric\nthreshold = 0.6\n\ntrain_max_reps = 5\n")
    assert "max_interesting = 27" in out and read_params(out, warn=pytest.fail).combine_mode == "geometric"
    assert write_params(out, ScoreParams(threshold=0.6, max_interesting=27)) == out


def test_threshold_precedence():
    assert resolve_threshold() == 0.5
    assert resolve_threshold(None, "0.7") == 0.7
    assert resolve_threshold(ScoreParams(threshold=0.6), "0.7") == 0.6
    assert resolve_threshold(ScoreParams(threshold=0.6), "0.7", 0.9) == 0.9
    assert resolve_threshold(None, "2") == 0.5


def test_config_from_env():
    assert TokenizerConfig.from_env({"QUILLSIFT_FOLD": "TRUE", "QUILLSIFT_TLD": "0"}.get) == TokenizerConfig(homoglyph_fold=True)
