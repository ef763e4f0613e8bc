"""Ordered folds over keyed events: the same state machines for batches and for streams."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from ..functions.udfs import spoken_sentences

FRAME_MS = 32.0


class Limits(NamedTuple):
    """Probabilities from which speech begins and under which it ends, and the times that confirm it."""

    start: float = 0.5
    end: float = 0.35
    min_speech_ms: float = 190.0
    silence_ms: float = 1200.0
    timeout_s: float = 30.0


class Listening(NamedTuple):
    """What is known of a turn.  ``against`` is how long the frames have spoken against the present mode."""

    speaking: bool = False
    against: float = 0.0
    total: float = 0.0
    said: bool = False
    gave_up: bool = False
    patience: float = 0.0


def listen(now: Listening, prob: float, limits: Limits) -> tuple[Listening, str | None]:
    """The next state and perhaps an event.  The mode flips once frames against it, without a break, last
    as long as it takes to confirm speech or, while speaking, as long as the patience with silence."""
    voiced = prob >= (limits.end if now.speaking else limits.start)
    contrary = voiced != now.speaking
    now = now._replace(total=now.total + FRAME_MS, against=now.against + FRAME_MS if contrary else 0.0)
    if contrary and now.against >= ((now.patience or limits.silence_ms) if now.speaking else limits.min_speech_ms):
        flipped = now._replace(speaking=not now.speaking, against=0.0, said=True, patience=0.0)
        return flipped, "speech_start" if flipped.speaking else "end_of_turn"
    if now.speaking and voiced:
        return now._replace(patience=0.0), None
    if not now.speaking and not voiced and not now.said and not now.gave_up and now.total >= limits.timeout_s * 1000:
        return now._replace(gave_up=True), "timeout"
    return now, None


def hold(now: Listening, extra_ms: float) -> Listening:
    """Keep a turn open that seems unfinished: it ends after ``extra_ms`` more silence."""
    return now._replace(speaking=True, against=0.0, patience=extra_ms)


class Endpoints:
    """``listen`` over the frames of one session."""

    def __init__(self, **limits):
        self.limits, self.now = Limits(**limits), Listening()

    def feed(self, prob: float) -> list[str]:
        self.now, event = listen(self.now, prob, self.limits)
        return [event] if event else []


def parse_turn(text: str, final: bool = False) -> tuple[list[str], str | None]:
    """(sentences that are certain, trailer after a line of dashes or None) of a turn's text so far.  Whole
    lines are certain; of the last line only what later text cannot change, and nothing while it may still
    become the line of dashes."""
    dashes = re.search(r"^[^\S\n]*-{3,}[^\S\n]*(\n|\Z)" if final else r"^[^\S\n]*-{3,}[^\S\n]*\n", text, re.M)
    spoken, trailer = (text[: dashes.start()], text[dashes.end() :]) if dashes else (text, None)
    *lines, last = spoken.split("\n")
    certain = [s for line in lines for s in spoken_sentences(line, True)[0]]
    if dashes or final:
        certain += spoken_sentences(last, True)[0]
    elif not re.fullmatch(r"\s*-+\s*", last):
        certain += spoken_sentences(last)[0]
    return certain, trailer


class Turn:
    """A turn's state is its text so far and how many sentences were handed out; each delta hands out the
    sentences that have become certain since."""

    def __init__(self):
        self.text, self.given = "", 0

    def feed(self, delta: str, final: bool = False) -> list[str]:
        self.text += delta
        certain, _ = parse_turn(self.text, final)
        fresh, self.given = certain[self.given :], max(self.given, len(certain))
        return fresh

    def finish(self) -> tuple[list[str], dict]:
        """(last sentences, the trailer's object or an empty one)."""
        late = self.feed("", True)
        try:
            meta = json.loads((parse_turn(self.text, True)[1] or "").strip() or "{}")
        except ValueError:
            meta = {}
        return late, meta if isinstance(meta, dict) else {}


class Reconciler:
    """Interim and final transcripts of segments: a final supersedes interims, interims are cumulative, and
    what ends at or before the committed time is late and dropped."""

    def __init__(self):
        self.committed, self.interim, self.finals = -1.0, None, []

    def feed(self, kind: str, end: float, text: str) -> list[tuple[float, str]]:
        if end <= self.committed:
            return []
        if kind == "final":
            self.committed, self.interim = end, None
            self.finals.append(text)
            return [(end, text)]
        self.interim = text
        return []

    def finish(self) -> str:
        return " ".join([*self.finals, *([self.interim] if self.interim else [])])


class Reservation:
    """One day's calls against a key's quota on one engine, the keys' budgets and the server's budget."""

    def __init__(self, quota: int, key_cap: int, server_cap: int):
        self.quota, self.key_cap, self.server_cap = quota, key_cap, server_cap
        self.used: dict = {}
        self.calls: dict = {}
        self.total = 0

    def feed(self, key, engine: str) -> str:
        if engine == "claude" and self.used.get(key, 0) >= self.quota:
            return "quota"
        if self.calls.get(key, 0) >= self.key_cap or self.total >= self.server_cap:
            return "budget"
        if engine == "claude":
            self.used[key] = self.used.get(key, 0) + 1
        self.calls[key] = self.calls.get(key, 0) + 1
        self.total += 1
        return "ok"


#: What a machine's state consists of: field -> how it comes back from JSON.  Settings are not state.
_pairs = lambda pairs: {k: v for k, v in pairs}
STATE = {
    Endpoints: {"now": lambda fields: Listening(**fields)},
    Turn: {"text": str, "given": int},
    Reconciler: {"committed": float, "interim": lambda x: x, "finals": list},
    Reservation: {"used": _pairs, "calls": _pairs, "total": int},
}


def freeze(machine) -> str:
    """The state as JSON, field by field: readable, and only data when it is read back."""

    def plain(x):
        return x._asdict() if isinstance(x, tuple) and hasattr(x, "_asdict") else list(map(list, x.items())) if isinstance(x, dict) else x

    return json.dumps({name: plain(getattr(machine, name)) for name in STATE[type(machine)]})


def thaw(machine, data: str):
    """``machine``, freshly made, in the stored state; a field that the state lacks keeps its beginning, one
    that is no longer known is left out."""
    stored = json.loads(data)
    for name, back in STATE[type(machine)].items():
        if name in stored:
            setattr(machine, name, back(stored[name]))
    return machine
