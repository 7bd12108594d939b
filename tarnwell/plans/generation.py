"""Driver-side control around providers: payloads, token budgets, a paced teacher, one-repair synthesis, fault injection.

Like the research loops, nothing here touches rows; a provider is a callable and time is injected.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields

from ..functions.config import GroundingError, ProviderError
from ..sources.sinks import strict_json
from . import research
from .research import Complete, Observation, parsed, redacted, view

AVOIDED = 5  # earlier scenarios that a batch request shows
MOST_TOKENS = 4096
# JSON Schema keys that only present, and those whose members are named by the schema's author.
PRESENTATION, NAMED = ("title", "description", "default"), ("properties", "$defs")


def batch_payload(assignments: list[dict], scenarios: Iterable[str]) -> str:
    """Request for one batch: its assignments and the latest scenarios, which new ones should not resemble."""
    return strict_json({"assignments": assignments, "avoid_similar_scenarios": list(scenarios)[-AVOIDED:]})


def compacted(schema):
    """A JSON Schema without presentation; members that merely are called title and the like stay."""
    if isinstance(schema, list):
        return [compacted(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    own = {k: v for k, v in schema.items() if k not in PRESENTATION}
    return {k: {name: compacted(x) for name, x in v.items()} if k in NAMED else compacted(v) for k, v in own.items()}


@dataclass(frozen=True)
class TokenBudgets:
    """Most output tokens of each kind of request."""

    planner: int = 768
    critique: int = 512
    brief: int = 1200
    clarification: int = 900
    followup: int = 640
    sentiment: int = 384
    sentiment_batch: int = 1800
    report: int = 1800

    def __post_init__(self):
        bad = [k for k, v in asdict(self).items() if isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= MOST_TOKENS]
        if bad:
            raise ValueError(f"budgets are whole numbers from 1 to {MOST_TOKENS}: {', '.join(bad)}")

    def of(self, stage: str | None) -> int:
        """Budget of a stage of the loops; an unknown one gets that of a report."""
        kind = {"report": "planner", "writer_review": "critique", "analyst_brief": "brief", "analyst_clarify": "clarification", "writer_report": "report", "follow_up": "followup"}.get(stage or "", stage)
        return getattr(self, kind if kind in {f.name for f in fields(self)} else "report")


class Teacher:
    """A provider with pauses between requests, bounded retries and one change from JSON to text mode.

    ask(system, payload, json_mode) answers or raises ProviderError; category json_rejected means that the provider
    could not keep to JSON. A wait beyond ``most`` is not made: the quota's end is kept, and later requests fail until it.
    """

    def __init__(self, ask: Callable[[str, str, bool], str], attempts: int = 3, most: float = 120.0, interval: float = 0.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.ask, self.attempts, self.most, self.interval, self.sleep, self.clock = ask, attempts, most, interval, sleep, clock
        self.last_end: float | None = None
        self.quota_end = float("-inf")

    def _pause(self) -> None:
        now = self.clock()
        if self.quota_end - now > self.most:
            raise ProviderError("the quota ends later", "rate_limit")
        rest = max(self.quota_end - now, 0.0 if self.last_end is None else self.last_end + self.interval - now)
        if rest > 0:
            self.sleep(rest)

    def __call__(self, system: str, payload: str) -> str:
        json_mode, tried = True, 0
        while True:
            self._pause()
            tried += 1
            try:
                answer = self.ask(system, payload, json_mode)
                self.last_end = self.clock()
                if not answer.strip():
                    raise ProviderError("the answer is empty", "empty_response")
                return answer
            except ProviderError as e:
                self.last_end = self.clock()
                rejected = e.category == "json_rejected" and json_mode
                wait = research.wait_before(tried - 1, e.retry_after)
                if wait > self.most and e.category == "rate_limit":
                    self.quota_end = self.last_end + wait
                if tried == self.attempts or wait > self.most or not (rejected or e.category in research.RETRIED):
                    raise
                json_mode = json_mode and not rejected
                self.sleep(wait)


def synthesised(complete: Complete, query: str, observations: list[Observation], check: Callable[[dict, list[Observation]], dict], context: dict | None = None, draft: dict | None = None, repaired: bool = False) -> research.Stage:
    """A report from what was observed, with at most one repair; no tool can be reached.

    draft: an output already at hand, judged instead of a first request. repaired: the one repair has been used before.
    """
    s = research.Stage(observations=observations)
    request = {"stage": "synthesis", "query": query, "context": context or {}, "allowed_evidence_ids": [o.evidence_id for o in observations if o.success], "observations": [view(o) for o in observations]}
    feedback = None
    for turn in range(1 if repaired else 2):
        try:
            if turn == 0 and draft is not None:
                output = redacted(draft)
            else:
                output = parsed(complete("synthesis", strict_json(redacted(request | {"feedback": feedback}))))
                if output.get("kind") == "finish" and isinstance(output.get("output"), dict):
                    output = output["output"]
            s.output = check(output, observations)
            s.events.append(("stage_output", {"turn": turn + 1}))
            return s
        except ProviderError as e:
            s.events.append(("transport_failure", {"category": e.category}))
            s.error = f"the provider failed: {e.category}"
            return s
        except GroundingError as e:
            feedback = str(e)
        except KeyError as e:
            feedback = f"schema: {e.args[0]} is missing"
        except (ValueError, TypeError):
            feedback = "schema"
        s.events.append(("output_rejected", {"turn": turn + 1, "reason": feedback}))
    s.error = f"no output passed: {feedback}"
    return s


class FailingOnce:
    """Tools of which one fails at its first call, to show how a run recovers."""

    def __init__(self, tools, name: str, error: Exception):
        self._tools, self._name, self._error = tools, name, error

    def __getattr__(self, name: str):
        found = getattr(self._tools, name)
        if name != self._name or self._error is None:
            return found

        def fail(*args, **kwargs):
            error, self._error = self._error, None
            raise error

        return fail


def log_to_stderr(level: int = logging.INFO) -> None:
    """Library messages with time and level; a logger that has handlers keeps them."""
    logger = logging.getLogger("tarnwell")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
