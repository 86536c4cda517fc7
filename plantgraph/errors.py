"""Failures with a stable code."""

from __future__ import annotations

from .schema import CATEGORY


class PlantError(Exception):
    """``code`` is one of schema.CODES; ``subject`` names what it is about."""

    def __init__(self, code: str, message: str = "", subject: str = "", details: tuple[str, ...] = ()):
        self.code, self.message, self.subject, self.details = code, message, subject, tuple(details)
        super().__init__(str(self))

    @property
    def category(self) -> str:
        return CATEGORY[self.code]

    def __str__(self) -> str:
        out = self.code + (f": {self.message}" if self.message else "") + (f" [{self.subject}]" if self.subject else "")
        return out + "".join(f"; {d}" for d in self.details)

    def with_subject(self, subject: str) -> PlantError:
        return PlantError(self.code, self.message, subject, self.details)
