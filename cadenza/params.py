"""Parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

RATE = 16_000
FRAME = 512


@dataclass(frozen=True)
class Segmenting:
    """When a segment closes, and how much of it is kept; seconds, but for threshold."""

    silence: float = 0.5
    longest: float = 12.0
    shortest: float = 0.3
    pad: float = 0.2
    search: float = 1.5
    threshold: float = 0.5
    adaptive: bool = False
    rate: int = RATE

    def frames(self, seconds: float) -> int:
        return max(1, int(seconds * self.rate / FRAME))

    def for_microphone(self) -> Segmenting:
        """The profile for transcribing a microphone."""
        return replace(self, silence=min(self.silence, 0.35), longest=min(self.longest, 12.0), shortest=0.1, pad=max(self.pad, 0.5))

    def for_system_audio(self) -> Segmenting:
        return replace(self, silence=0.8, longest=12.0)


@dataclass(frozen=True)
class Joining:
    """Join short segments up to `least`, hold one no longer than `hold`, never across a pause of `pause`."""

    least: float = 10.0
    hold: float = 6.0
    pause: float = 4.0
    rate: int = RATE


#: Joining by (source, low latency).
JOINING = {
    ("microphone", False): Joining(10.0, 6.0, 4.0),
    ("microphone", True): Joining(4.0, 2.0, 2.0),
    ("system", False): Joining(10.0, 6.0, 4.0),
    ("system", True): Joining(10.0, 6.0, 4.0),
}


@dataclass(frozen=True)
class Scoring:
    """Thresholds of one profile of model output."""

    no_speech: float
    logprob: float
    beam: int
    exact_blocklist: bool
    boilerplate: bool
    prompt: bool
    inner_vad: bool


#: The seven scoring profiles.
SCORING = {
    "dictation": Scoring(0.6, -1.0, 5, True, False, True, True),
    "transcription": Scoring(0.95, -3.0, 5, False, True, False, False),
    "command": Scoring(0.8, -1.5, 1, False, False, True, True),
    "word": Scoring(0.9, -2.0, 5, False, False, False, True),
    "probe": Scoring(0.95, -3.0, 1, False, False, False, False),
    "recovery": Scoring(0.99, -5.0, 8, False, True, False, False),
    "refinement": Scoring(0.99, -5.0, 8, False, True, False, False),
}


@dataclass(frozen=True)
class Paragraphs:
    """Characters and seconds at which a paragraph may, should and must end; hardest 0: twice `most`; least 0: never."""

    least: int = 120
    pause: float = 0.7
    most: int = 400
    hardest: int = 0


@dataclass(frozen=True)
class Recovery:
    """Gaps that are worth another try, and what is accepted from it."""

    shortest: float = 2.0
    longest: float = 45.0
    rms: float = 0.0015
    frame_rms: float = 0.003
    active: float = 0.03
    logprob: float = -1.0
