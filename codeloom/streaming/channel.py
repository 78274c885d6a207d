"""A bounded channel from one writer to many readers."""

from __future__ import annotations

from collections import deque


class Lagged(Exception):
    """A reader was so slow that records were dropped before it read them."""


class Channel:
    """Keeps the newest ``capacity`` records; each reader has its own place."""

    def __init__(self, capacity: int = 128):
        self.kept: deque = deque(maxlen=capacity)
        self.sent = 0

    def send(self, record) -> None:
        self.kept.append(record)
        self.sent += 1

    def reader(self):
        """Records from now on, as far as there are any; ``Lagged`` ends it."""
        at = self.sent

        def read() -> list:
            nonlocal at
            behind = self.sent - at
            if behind > len(self.kept):
                raise Lagged(f"{behind - len(self.kept)} records were dropped")
            out, at = list(self.kept)[len(self.kept) - behind :], self.sent
            return out

        return read
