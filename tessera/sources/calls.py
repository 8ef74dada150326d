"""Calls to slow things (models, renderers) from within a task: some in flight at a time, answers in the order of the requests, none of them left behind.

Without a time limit the calls run on threads that the task waits for. With one they run in child processes: a call that takes too long is ended with its process, and a new one takes
the next request. Processes are forked, so `make` needs no copy and should open connections itself, in the child. At most two windows of requests are taken beyond what has been given back, so a slow call holds the input up rather than memory.
"""

from __future__ import annotations

import multiprocessing
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from multiprocessing.connection import wait
from typing import Any

#: Makes what is called, once for each task on threads, once for each process in processes.
Make = Callable[[], Callable[[Any], Any]]


def answers(make: Make, requests: Iterable[Any], width: int = 8, timeout: float | None = None) -> Iterator[tuple[Any, bool]]:
    """(answer, False) of each request in order, or (None, True) of one that took longer than `timeout` seconds. `width` are in flight at a time.

    An error of a call is raised here, once the answers before it are out; every other call in flight is ended first."""
    return _threads(make, requests, width) if timeout is None else _processes(make, requests, width, timeout)


def _threads(make: Make, requests: Iterable[Any], width: int) -> Iterator[tuple[Any, bool]]:
    ask = make()
    if width == 1:
        for r in requests:
            yield ask(r), False
        return
    pool = ThreadPoolExecutor(width)
    try:
        jobs: deque = deque()
        for r in requests:
            jobs.append(pool.submit(ask, r))
            if len(jobs) == 2 * width:
                yield jobs.popleft().result(), False
        while jobs:
            yield jobs.popleft().result(), False
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def _serve(make: Make, pipe) -> None:
    """A child's life: a request, its answer, until the pipe is closed."""
    ask = make()
    while True:
        try:
            request = pipe.recv()
        except EOFError:
            return
        try:
            answer = (True, ask(request))
        except Exception as error:  # told to the parent, which raises it
            answer = (False, f"{type(error).__name__}: {error}")
        pipe.send(answer)


class Child:
    def __init__(self, make: Make):
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(make, theirs), daemon=True)
        self.process.start()
        theirs.close()
        self.place, self.until = -1, 0.0

    def give(self, place: int, request: Any, timeout: float) -> None:
        self.place, self.until = place, time.monotonic() + timeout
        self.pipe.send(request)

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


def _processes(make: Make, requests: Iterable[Any], width: int, timeout: float) -> Iterator[tuple[Any, bool]]:
    idle: list[Child] = []
    busy: list[Child] = []
    done: dict[int, tuple[bool, Any, bool]] = {}
    todo, taken, out, more = iter(requests), 0, 0, True
    try:
        while more or busy or done:
            while more and len(busy) < width and taken - out < 2 * width:
                try:
                    request = next(todo)
                except StopIteration:
                    more = False
                    break
                child = idle.pop() if idle else Child(make)
                busy.append(child)
                child.give(taken, request, timeout)
                taken += 1
            if busy and out not in done:
                ready = wait([c.pipe for c in busy], max(0.0, min(c.until for c in busy) - time.monotonic()))
                now = time.monotonic()
                for child in list(busy):
                    if child.pipe in ready:
                        busy.remove(child)
                        try:
                            fine, answer = child.pipe.recv()
                            idle.append(child)
                        except EOFError:
                            fine, answer = False, "the process of a call ended"
                            child.end()
                        done[child.place] = (fine, answer, False)
                    elif child.until <= now:
                        busy.remove(child)
                        child.end()
                        done[child.place] = (True, None, True)
            while out in done:
                fine, answer, late = done.pop(out)
                out += 1
                if not fine:
                    raise RuntimeError(answer)
                yield answer, late
    finally:
        for child in (*idle, *busy):
            child.end()
