"""A passive recorder of a chain's outputs; hands each to ``observe`` as a step.

``EVENTS`` names the calls that chain libraries make, the role that each
output gets and how its text is read.  Whatever fails in the recorder stays in
it: the chain goes on.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from functools import partial
from itertools import chain

log = logging.getLogger(__name__)


def _joined(parts: Iterable) -> str:
    return " ".join(p for p in parts if isinstance(p, str) and p)


def _generated(response) -> str:
    """All texts of a model's answer, whatever batch they are in."""
    answers = chain.from_iterable(getattr(response, "generations", None) or ())
    return _joined(getattr(answer, "text", None) for answer in answers)


def _outputs(value) -> str:
    """The texts among named outputs, or the one output as text."""
    return _joined(value.values()) if isinstance(value, Mapping) else str(value)


#: Event: role and reader of its text.
EVENTS: dict[str, tuple[str, Callable[[object], str]]] = {"on_llm_end": ("llm", _generated), "on_chain_end": ("chain", _outputs), "on_tool_end": ("tool", str)}


class ChainRecorder:
    """Has a method for each of ``EVENTS``; steps are numbered from 1."""

    def __init__(self, observe: Callable[[dict], object]):
        self.observe, self.steps = observe, 0

    def __getattr__(self, event: str):
        if event not in EVENTS:
            raise AttributeError(event)
        return partial(self.record, event)

    def record(self, event: str, output, *, name: str | None = None, **_more) -> None:
        role, read = EVENTS[event]
        try:
            text = read(output)
            if not text.strip():
                return
            self.steps += 1
            self.observe({"step_id": self.steps, "agent_name": name, "role": role, "text": text})
        except Exception as e:  # the chain must not notice
            log.warning("%s was not recorded: %s", event, e)
