"""The transducer of threats: who says it, the modal, the verb, the object behind it."""

from __future__ import annotations

import pytest

from lodestone.llm import toxicity

G = toxicity.Grammar({"idiot": 3.0})


def score(text):
    return round(G.clause(toxicity.WORD.findall(text.lower())), 6)


@pytest.mark.parametrize("text", ["i will kill you", "we will hurt them", "I am going to kill all of you", "ich werde dich schlagen", "wir werden euch töten", "je vais te frapper", "yo voy a golpear a ellos", "i kill you", "we gonna smash your face"])
def test_threats_with_an_object(text):
    assert score(text) == 3.75


@pytest.mark.parametrize("text", ["you will kill time", "they should beat the eggs", "i kill time", "we will smash records", "kill the lights", "du wirst zeit schlagen"])
def test_verbs_without_one(text):
    assert score(text) == 0


def test_as_before():
    assert score("they kill") == score("you hurt people") == 3.75 and score("you will kill him") == 3.75
    assert score("i will not kill you") == 0.5 * 3.75 and score("she said i will kill you") == pytest.approx(0.6 * 3.75)
    assert score("i will kill you idiot") == 2 * 3.75 and score("i will kill you and burn them") == 2 * 3.75
    assert toxicity.govern([], []) == []
