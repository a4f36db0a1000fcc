"""A queue of training rounds that is registered before the first of them runs, with a ledger that survives broken runs.

The ledger keeps the digest of the queue it belongs to: a queue that was changed afterwards is refused, so that
rounds cannot be chosen by their results. A round that is in the ledger is not run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from .training import Plan


@dataclass(frozen=True)
class Round:
    """One change to try: sets of derived features, patterns of excluded ones, settings of a plan, and the reason."""

    name: str
    reason: str = ""
    sets: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    @classmethod
    def of(cls, said: dict) -> Round:
        if unknown := sorted(set(said) - set(cls.__dataclass_fields__)):
            raise ValueError(f"no such parts of a round: {unknown}")
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})
        plan_of(made.settings)  # an unsound plan is found before anything runs
        return made

    def said(self) -> dict:
        return {"name": self.name, "reason": self.reason, "sets": list(self.sets), "exclude": list(self.exclude), "settings": self.settings}


def plan_of(settings: dict) -> Plan:
    return Plan.of({k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def queue_of(said: list[dict]) -> list[Round]:
    rounds = [Round.of(x) for x in said]
    if not rounds or len({r.name for r in rounds}) < len(rounds):
        raise ValueError("a queue has a round at least, and each a name of its own")
    return rounds


class Ledger:
    """Results by round, in the order in which they came; ``folder`` reads and replaces small files whole."""

    def __init__(self, folder, queue: list[Round], identity: Callable[..., str]):
        self.folder, self.queue = folder, queue
        self.registered = identity(queue=json.dumps([r.said() for r in queue], sort_keys=True))
        text = folder.text("ledger.json")
        held = json.loads(text) if text else {"queue": self.registered, "results": []}
        if held["queue"] != self.registered:
            raise ValueError("the ledger belongs to another queue")
        self.results = held["results"]

    def pending(self) -> list[Round]:
        done = {r["name"] for r in self.results}
        return [r for r in self.queue if r.name not in done]

    def add(self, name: str, **result) -> None:
        self.results.append({"name": name, **result})
        self.folder.put(json.dumps({"queue": self.registered, "results": self.results}, indent=1), "ledger.json")

    def best(self) -> dict | None:
        """The result of the highest score; the earlier of equal ones."""
        scored = [r for r in self.results if r.get("score") is not None]
        return max(scored, key=lambda r: r["score"]) if scored else None


def run(ledger: Ledger, train: Callable[[Round], dict]) -> dict | None:
    """Runs what is pending, one round after the other, each recorded as soon as it has ended; the best result."""
    for r in ledger.pending():
        ledger.add(r.name, **train(r))
    return ledger.best()
