"""What the machine at hand tells of itself: its timers and its journal.

Every query goes through `ask`, which tests and remote set-ups replace: it takes a command and a time
limit and gives the lines of the answer, or raises Silent.
"""
from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable
from datetime import datetime

#: Seconds that an answer may take.
MANAGER_S, JOURNAL_S = 30.0, 120.0


class Silent(RuntimeError):
    """The machine gave no answer."""


def ask(command: list[str], limit: float) -> list[str]:
    try:
        return subprocess.run(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, encoding="utf-8", errors="replace", timeout=limit, check=True).stdout.splitlines()
    except subprocess.CalledProcessError as e:
        raise Silent(e.stderr.strip() or f"exit status {e.returncode}") from e
    except (OSError, subprocess.TimeoutExpired) as e:
        raise Silent(e) from e


Ask = Callable[[list[str], float], list[str]]


def _manager(verb: str, *args: str, ask: Ask) -> list[str]:
    try:
        return ask(["systemctl", verb, "--no-pager", *args], MANAGER_S)
    except Silent as e:
        raise Silent(f"systemctl {verb} failed: {e}") from e


def timers(ask: Ask = ask) -> set[str]:
    """Names of all timer units."""
    table = _manager("list-units", "--type=timer", "--all", "--plain", "--no-legend", ask=ask)
    return {unit for unit, *_ in map(str.split, filter(str.strip, table)) if unit.endswith(".timer")}


def show(units: Iterable[str], ask: Ask = ask) -> list[str]:
    """Property lines of units."""
    units = sorted(units)
    return _manager("show", *units, ask=ask) if units else []


def journal(matchers: list[str], since: datetime, until: datetime, ask: Ask = ask) -> list[str]:
    """Journal lines of a window; matchers say of whom."""
    span = [x for option, t in (("--since", since), ("--until", until)) for x in (option, t.isoformat(" ", "seconds"))]
    try:
        return ask(["journalctl", "--no-pager", "--output=short-iso", *span, *matchers], JOURNAL_S)
    except Silent as e:
        raise Silent(f"journalctl {' '.join(matchers)} failed: {e}") from e
