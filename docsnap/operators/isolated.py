"""A function in a process of its own, with limits on its time and memory."""

from __future__ import annotations

import multiprocessing
import resource
from collections.abc import Callable
from typing import Any


def _serve(ours, pipe, function: Callable[[bytes], Any], memory_limit: int | None) -> None:
    ours.close()  # else this process would never see that the other is gone
    if memory_limit is not None:
        resource.setrlimit(resource.RLIMIT_DATA, (memory_limit, memory_limit))
    while True:
        try:
            data = pipe.recv_bytes()
        except EOFError:
            return
        try:
            answer = function(data), None
        except MemoryError:
            answer = None, ("MemoryError", "the function took too much memory")
        except Exception as problem:  # noqa: BLE001 - the caller carries it on
            answer = None, (type(problem).__name__, str(problem))
        try:
            pipe.send(answer)
        except Exception as problem:  # noqa: BLE001 - an answer that cannot be sent
            pipe.send((None, (type(problem).__name__, str(problem))))


class Failed(Exception):
    """What went wrong in the process; shown under the name it had there."""


class Child:
    """One process that answers call after call; after a call that did not end well, another."""

    def __init__(self, function: Callable[[bytes], Any], time_limit: float | None, memory_limit: int | None) -> None:
        self.function, self.time_limit, self.memory_limit = function, time_limit, memory_limit
        self.process = self.pipe = None

    def _begin(self) -> None:
        # A copy of this process needs no import and no pickle of the function.
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(
            target=_serve, args=(self.pipe, theirs, self.function, self.memory_limit), daemon=True
        )
        self.process.start()
        theirs.close()

    def call(self, data: bytes) -> Any:
        if self.process is None or not self.process.is_alive():
            self._begin()
        try:
            self.pipe.send_bytes(data)
            if not self.pipe.poll(self.time_limit):
                self.end()
                raise TimeoutError(f"extraction took longer than {self.time_limit} s")
            found, failed = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.process.join()
            code = self.process.exitcode
            self.end()
            raise ChildProcessError(f"extraction ended with exit code {code}") from None
        if failed is not None:
            raise type(failed[0], (Failed,), {})(failed[1])
        return found

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
        self.process = self.pipe = None
