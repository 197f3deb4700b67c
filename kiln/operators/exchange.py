"""Exchange between the tasks of a barrier stage.

``BarrierTaskContext.allGather`` asks the driver and looks for the answer once
a second, so a loop of small exchanges takes a second a turn whatever is sent.
Where the tasks mount the session's shared folder, they pass the texts through
files in it instead: each writes its own and reads those of the others.
"""

from __future__ import annotations

import os
import time
from urllib.parse import urlparse

PATIENCE = 3600.0  # seconds a task waits for another one's file


def mounted(path: str) -> str | None:
    """The path as tasks open it, None for one that only Hadoop reads."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") and url.path.startswith("/") else None


def _write(path: str, text: str) -> None:
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.rename(f"{path}.part", path)  # readers see whole files only


def _read(path: str) -> str:
    pause, until = 0.0002, time.monotonic() + PATIENCE
    while True:
        try:
            with open(path) as f:
                return f.read()
        except FileNotFoundError:
            if time.monotonic() > until:
                raise TimeoutError(f"no answer from another task of the stage: {path}") from None
        time.sleep(pause)
        pause = min(pause * 1.5, 0.02)


def gatherer(context, folder: str | None):
    """The stage's ``allGather``: texts of all tasks in the order of their
    partitions.  ``folder``: a mounted folder, deleted by the driver; if any
    task does not see the others' files in it, all of them ask the driver.

    Names hold the attempts of the tasks, so a stage that runs again reads
    nothing of the run before.  A task that writes its next text has read all
    of the last turn, so its own file of the turn before that is deleted."""
    if folder is None:
        return context.allGather
    probe = f"{folder}/probe-{context.taskAttemptId()}"
    try:
        _write(probe, "")
    except OSError:
        probe = ""
    probes = context.allGather(probe)
    seen = all(p and os.path.exists(p) for p in probes)
    if "no" in context.allGather("yes" if seen else "no"):
        return context.allGather
    run = "-".join(p.rsplit("-", 1)[1] for p in probes)
    own, turn = context.partitionId(), 0

    def name(turn, task):
        return f"{folder}/{run}-{turn}-{task}"

    def exchange(text: str) -> list:
        nonlocal turn
        _write(name(turn, own), text)
        texts = [text if i == own else _read(name(turn, i)) for i in range(len(probes))]
        if turn:
            os.remove(name(turn - 1, own))
        turn += 1
        return texts
    return exchange
