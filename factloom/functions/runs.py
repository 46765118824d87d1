"""Greedy windows over a session's turns: the fold that the batch and the stream operator share."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """What closes a window: tokens or characters before a turn is added, turns after.

    ``overlap`` turns of a closed window begin the next one. No limit of characters if most_chars is 0.
    """

    most_tokens: int = 1200
    most_turns: int = 12
    most_chars: int = 0
    overlap: int = 0


@dataclass
class Run:
    """The open window of a session: its number and its turns (idx, tokens, characters), at most most_turns of them."""

    limits: Limits
    number: int = 0
    turns: list[tuple[int, int, int]] = field(default_factory=list)

    def _close(self, reason: str) -> tuple:
        done = (self.number, self.turns[0][0], self.turns[-1][0], len(self.turns), sum(t[1] for t in self.turns), reason)
        self.number += 1
        self.turns = self.turns[-self.limits.overlap :] if self.limits.overlap else []
        return done

    def add(self, idx: int, tokens: int, chars: int) -> list[tuple]:
        """Takes a turn; the windows (number, first, last, turns, tokens, reason) that this closes."""
        out, most = [], self.limits
        if self.turns and sum(t[1] for t in self.turns) + tokens > most.most_tokens:
            out.append(self._close("max_tokens"))
        elif self.turns and most.most_chars and sum(t[2] for t in self.turns) + chars > most.most_chars:
            out.append(self._close("max_chars"))
        self.turns.append((idx, tokens, chars))
        if len(self.turns) >= most.most_turns:
            out.append(self._close("max_turns"))
        return out

    def end(self) -> list[tuple]:
        """The session ends: what is still open (also turns kept as overlap) is closed."""
        out = [self._close("session_end")] if self.turns else []
        self.number, self.turns = 0, []
        return out
