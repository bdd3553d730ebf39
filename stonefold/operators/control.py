"""Extension points: a barrier that holds writers still, and a handler of commands."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager
from typing import Any

from pyspark.sql import DataFrame


def behind(barrier: Callable[[], AbstractContextManager | None], cycle: Callable[[], DataFrame]) -> DataFrame | None:
    """Run a collection while the caller's guard holds writers still; None, and nothing is freed, if it cannot be had.

    The cycle's result is checkpointed before the guard is let go: a lazy plan
    would read the tables after it.
    """
    guard = barrier()
    if guard is None:
        return None
    with guard:
        return cycle().checkpoint()


class Control:
    """Commands by name; each takes keyword arguments and returns a table or a plain value."""

    def __init__(self, commands: dict[str, Callable[..., Any]] | None = None):
        self.commands = dict(commands or {})

    def register(self, name: str, command: Callable[..., Any]) -> None:
        if name in self.commands:
            raise ValueError(f"the command {name} is there already")
        self.commands[name] = command

    def handle(self, name: str, **arguments: Any) -> dict[str, Any]:
        """What a command returned, or the fault: of an unknown name, of arguments, or of the command itself."""
        if name not in self.commands:
            return {"ok": False, "error": f"unknown command {name}"}
        try:
            return {"ok": True, "result": self.commands[name](**arguments)}
        except (TypeError, ValueError, RuntimeError) as e:
            return {"ok": False, "error": str(e)}
