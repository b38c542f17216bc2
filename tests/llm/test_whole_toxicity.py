"""Toxic words that long tokens, short or partial spacings and digits hide."""

import numpy as np
import pytest

from millrace.llm import charlm, toxicity


@pytest.fixture(scope="module")
def table():
    texts = ["the loser is an idiot and a clown with stupid trash in the hall will pass all pathetic morons as a bass of bias"] * 20
    flat, _ = charlm.points(texts)
    return charlm.log_probabilities(charlm.counted(charlm.class_table()[flat]))


@pytest.fixture(scope="module")
def score(table):
    return toxicity.Model(table, {"stupid$": 9.0, "bass$": 9.0, "bias$": 9.0}, -3.0).scorer()


@pytest.mark.parametrize("lead", range(50, 62))
def test_a_word_in_a_long_token_is_whole_wherever_it_lies(table, lead):
    token = ("the.hall." * 8)[:lead] + ".stup1d." + "hall." * 8
    assert "stupid" in toxicity.Restorer(table).restore_token(token)


@pytest.mark.parametrize("words", range(3, 12))
def test_a_word_in_a_long_row_is_whole_wherever_it_lies(table, words):
    row = " ".join("trash" * words + "stupid" + "hall" * 3)
    assert any("stupid" in w for w in toxicity.Restorer(table).spelled(row))


@pytest.mark.parametrize("text", ["you st upid man", "you stu pid man", "you s tu pid, man", "you 5t up1d!", "a b a s s", "57up1d", "so 8145"])
def test_spaced_and_numeric_words_count(score, text):
    assert score(text) > 0.9


@pytest.mark.parametrize("text", ["the hall is all", "a b c d", "st. the upid", "as a pass", "2024 455 1995", "st " * 4000])
def test_plain_texts_stay_clean(score, text):
    assert score(text) < 0.1
