"""The scoring model is trained on all training text."""

import inspect

from arcloom.llm.scoring import score_documents


def test_turns_take_every_span():
    given = inspect.signature(score_documents).parameters
    assert given["turns"].default >= given["stride"].default
