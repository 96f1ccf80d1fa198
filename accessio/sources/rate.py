"""A budget of requests a second that tasks share without talking to each other."""

from __future__ import annotations

import math
import time
from collections.abc import Callable


class Slots:
    """Time cut into slots of 1 / rate seconds from start on; task k of n owns the slots k, k + n, k + 2n ...

    wait() returns at the beginning of the owner's next slot and takes it. No two
    tasks own a slot, so all together begin at most one request a slot, whatever
    each request takes. Slots that pass while a task is busy or hasn't begun are
    lost, not saved up, so there are no bursts. The tasks' clocks must agree to a slot
    or so; speculative copies of a task would share its slots.
    """

    def __init__(self, rate: float, start: float, task: int = 0, tasks: int = 1, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or not 0 <= task < tasks:
            raise ValueError(f"no slots for rate {rate}, task {task} of {tasks}")
        self.rate, self.start, self.task, self.tasks, self.clock, self.sleep = rate, start, task, tasks, clock, sleep
        self.turn = 0  # the owner's slots up to here are taken or lost

    def wait(self) -> None:
        passed = (self.clock() - self.start) * self.rate
        self.turn = max(self.turn, math.ceil((passed - self.task) / self.tasks))
        begins = self.start + (self.turn * self.tasks + self.task) / self.rate
        self.turn += 1
        while (left := begins - self.clock()) > 0:
            self.sleep(left)
