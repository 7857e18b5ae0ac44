"""Errors with a stable code and a process exit code."""

from __future__ import annotations

RUNTIME, USAGE, NOT_A_STORE, POLICY, COLLISION, VALIDATION = 1, 2, 3, 4, 5, 6


class StoreError(Exception):
    """``code`` is stable for programs; ``exit_code`` is what a command would end with."""

    def __init__(self, code: str, message: str, exit_code: int = RUNTIME) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.exit_code = code, message, exit_code


def usage(code: str, message: str) -> StoreError:
    return StoreError(code, message, USAGE)
