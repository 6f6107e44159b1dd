"""The sweep behind nearest matching, as chunk states that can be composed.

Going down the score axis, the state is a first-come queue of waiting treated units and a stack of free
controls, the nearest on top.  The axis is cut into chunks.  A chunk is swept on its own from an incoming
state and says what it took from the queue and the stack it was given, and which of its own treated still
wait and which of its own controls stay free.  These leftovers are all that is handed on: the queue and the
stack before a chunk are made of leftovers of earlier chunks, found by counting units.

:class:`Coordinator` sweeps all chunks at once as if nothing came in, then follows the states down the
axis.  A chunk is swept again only where the part of its incoming state that it looked at has changed, until
every chunk has seen its true state.  Two states need no second sweep: nothing comes in, or so many wait that the
chunk's controls never outnumber them and no control above is near enough to be taken instead (then everything
is first come, first served).  Whoever waits at the end of the axis takes the free controls above, nearest first:
that is again a matter of counting.  The driver holds one record per chunk; units stay in the tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace


@dataclass
class Unit:
    """A run of interchangeable units: equal score, consecutive ranks.  ``own``: of the chunk being swept.

    A unit that came in with the queue has its place in that queue as ``rank``.
    """

    score: float
    rank: int
    n: int
    own: bool = True


class Sweep:
    """Matching along falling scores over one chunk, fed one distinct score at a time.

    Only the waiting treated and the free controls are held; finished runs can be taken away with
    :meth:`flush` at any time.
    """

    def __init__(self, queue: Iterable[Unit] = (), stack: Iterable[Unit] = ()):
        self.queue, self.free = deque(queue), list(stack)
        self.given = sum(u.n for u in self.queue), sum(u.n for u in self.free)
        self.taken = self.popped = 0  # units used of the given queue and stack
        self.queue_seen = self.stack_seen = 0  # units looked at
        self.queue_end = self.stack_end = False  # an answer depended on there being no more of them
        self.need = self._surplus = 0
        self.pairs: list = []  # treated score, rank, control score, rank, n
        self.served: list = []  # place in the given queue, control score, rank, n

    def flush(self) -> tuple[list, list]:
        done = self.pairs, self.served
        self.pairs, self.served = [], []
        return done

    def _match(self, head: Unit, control: Unit) -> None:
        n = min(head.n, control.n)
        if head.own:
            self.pairs.append((head.score, head.rank, control.score, control.rank, n))
        else:
            self.served.append((head.rank, control.score, control.rank, n))
            self.taken += n
        if not control.own:
            self.popped += n
        for unit in (head, control):
            unit.rank += n
            unit.n -= n
        if not head.n:
            self.queue.popleft()
        if self.free and not self.free[-1].n:
            self.free.pop()

    def _head(self) -> Unit | None:
        """First waiting unit; notes what was looked at."""
        head = self.queue[0] if self.queue else None
        if head is not None and not head.own:
            self.queue_seen = max(self.queue_seen, self.taken + 1)
        else:
            self.queue_end = True
        return head

    def _above(self) -> Unit | None:
        """Nearest free control above; notes what was looked at."""
        top = self.free[-1] if self.free else None
        if top is None:
            self.stack_end = True
        elif not top.own:
            self.stack_seen = max(self.stack_seen, self.popped + 1)
        return top

    def step(self, score: float, treated: int, controls: int) -> None:
        self._surplus += controls - treated
        self.need = max(self.need, self._surplus)
        if treated:
            self.queue.append(Unit(score, 0, treated))
        here = Unit(score, 0, controls)
        while here.n and (head := self._head()) is not None:
            top = self._above()
            nearer = top is not None and top.score - head.score <= head.score - score
            self._match(head, top if nearer else here)
        if here.n:
            self.free.append(here)

    def result(self) -> "Result":
        left = [u for u in self.queue if u.own]
        free = [u for u in self.free if u.own]
        return Result(
            taken=self.taken,
            popped=self.popped,
            queue_seen=self.queue_seen,
            stack_seen=self.stack_seen,
            queue_end=self.queue_end,
            stack_end=self.stack_end,
            need=self.need,
            left=sum(u.n for u in left),
            free=sum(u.n for u in free),
            left_top=left[0].score if left else 0.0,
            free_top=free[-1].score if free else 0.0,
            left_marks=marks(left),
            free_marks=marks(free[::-1]),
        )


def marks(units: list[Unit]) -> list[str]:
    """Digests of the first 1, 2, 4, ... units and of all."""
    out, running, seen, bound = [], hashlib.blake2b(digest_size=8), 0, 1
    for u in units:
        while bound <= seen + u.n:
            part = running.copy()
            part.update(repr((u.score, u.rank, bound - seen)).encode())
            out.append(part.hexdigest())
            bound *= 2
        running.update(repr((u.score, u.rank, u.n)).encode())
        seen += u.n
    out.append(running.hexdigest())
    return out


@dataclass
class Result:
    """What a chunk did with the state it was given, and what it leaves behind."""

    taken: int = 0
    popped: int = 0
    queue_seen: int = 0
    stack_seen: int = 0
    queue_end: bool = False
    stack_end: bool = False
    need: int = 0
    left: int = 0
    free: int = 0
    left_top: float = 0.0  # score of the first that waits
    free_top: float = 0.0  # score of the nearest free control
    left_marks: list[str] = field(default_factory=list)
    free_marks: list[str] = field(default_factory=list)


@dataclass
class Segment:
    """Leftover units ``low`` to ``high`` of a chunk, as it was swept in a certain round.

    Units of a queue count from its front, units of a stack from its bottom.
    """

    chunk: int
    round: int
    low: int
    high: int


@dataclass
class Order:
    """A chunk to sweep, with its incoming state."""

    chunk: int
    waiting: int  # units in the whole incoming queue; scores are only handed where a control above is free
    queue: list[Segment]
    stack: list[Segment]


@dataclass
class Chunk:
    """Facts of a chunk of the axis."""

    treated: int
    controls: int
    highest: float
    lowest: float


@dataclass
class Settled:
    """A chunk's place in the one queue of the whole axis."""

    round: int | None  # None: first come, first served throughout
    entered: int  # number of the first of its own leftover units
    served: int  # number of the first unit of the queue that it was given


class Coordinator:
    """Follows the states down the axis; ``chunks`` from the top."""

    def __init__(self, chunks: list[Chunk]):
        self.chunks = chunks
        self.results: list[Result] = [Result()] * len(chunks)
        self.rounds = [0] * len(chunks)
        self.seen: list[tuple] = [()] * len(chunks)
        self.swept = 0  # chunks swept so far
        self.settled: list[Settled] = []
        # free controls at the end of the axis, bottom first, and the numbers of those who still wait
        self.rest: list[Segment] = []
        self.waiting = 0, 0

    def run(self, sweep: Callable[[int, list[Order]], dict[int, Result]]) -> None:
        """``sweep`` is given the round and the chunks to sweep; it returns their results."""
        orders = [Order(i, 0, [], []) for i in range(len(self.chunks))]
        looked = {i: self._looker(0, [], []) for i in range(len(self.chunks))}
        number = 0
        while orders:
            found = sweep(number, orders)
            self.swept += len(orders)
            for order in orders:
                i = order.chunk
                self.results[i], self.rounds[i] = found[i], number
                self.seen[i] = looked[i](found[i])
            stale = self._follow()
            number += 1
            # the first repetition takes all; later ones wait for a stale chunk above
            chosen = [i for i in stale if number == 1 or i - 1 not in stale]
            orders = [stale[i][0] for i in chosen]
            looked = {i: stale[i][1] for i in chosen}

    def _follow(self) -> dict[int, tuple[Order, Callable]]:
        """One pass down the axis; the chunks whose result does not belong to their incoming state."""
        stale: dict[int, tuple[Order, Callable]] = {}
        self.settled = []
        queue: deque[Segment] = deque()  # waiting units, front first
        stack: list[Segment] = []  # free controls, bottom first
        entered = served = free = 0
        for i, chunk in enumerate(self.chunks):
            r = self.results[i]
            waiting = entered - served
            if waiting and waiting >= r.need and self._out_of_reach(chunk, queue, stack):
                # all controls go to whoever waits longest, all treated join the queue
                self.settled.append(Settled(None, entered, served))
                taken, popped, left, own_free, made = chunk.controls, 0, chunk.treated, 0, None
            else:
                look = self._looker(waiting, queue, stack)
                self.settled.append(Settled(self.rounds[i], entered, served))
                taken, popped = r.taken, min(r.popped, free)
                if look(r) != self.seen[i]:
                    stale[i] = self._order(i, waiting, free, queue, stack), look
                    taken = waiting  # for now: mostly who comes in waiting is served inside
                left, own_free, made = r.left, r.free, self.rounds[i]
            if made is None:
                queue.append(Segment(i, -1, 0, left))
                _drop_front(queue, taken)
            else:
                _drop_front(queue, taken)
                if left:
                    queue.append(Segment(i, made, 0, left))
            free -= popped
            _drop_top(stack, popped)
            if own_free:
                stack.append(Segment(i, made, 0, own_free))
            entered, served, free = entered + left, served + taken, free + own_free
        self.rest, self.waiting = stack, (served, entered)
        return stale

    def _out_of_reach(self, chunk: Chunk, queue: deque[Segment], stack: list[Segment]) -> bool:
        """No control above is as near to anyone waiting as the chunk's lowest score is."""
        if not stack:
            return True
        first, top = queue[0], stack[-1]
        head = self.chunks[first.chunk].highest if first.round < 0 else self.results[first.chunk].left_top
        return self.results[top.chunk].free_top - head > head - chunk.lowest

    def _order(self, i: int, waiting: int, free: int, queue: Iterable[Segment], stack: list[Segment]) -> Order:
        if not free:
            return Order(i, waiting, [], [])
        # no more than these can be used up, whatever the scores
        front = _first(queue, min(waiting, self.chunks[i].controls + free))
        top = _first([Segment(s.chunk, s.round, -s.high, -s.low) for s in reversed(stack)], min(free, waiting + self.chunks[i].treated))
        return Order(i, waiting, front, [Segment(s.chunk, s.round, -s.high, -s.low) for s in reversed(top)])

    def _looker(self, waiting: int, queue: Iterable[Segment], stack: list[Segment]) -> Callable[[Result], tuple]:
        """Describes what a result looked at of this state; equal descriptions mean equal answers."""
        queue, stack = [replace(s) for s in queue], [replace(s) for s in stack]  # as they are now
        free = sum(s.high - s.low for s in stack)
        known = {s.chunk: self.results[s.chunk] for s in [*queue, *stack]}

        def look(r: Result) -> tuple:
            if not free:
                return "none above", waiting
            fronts = [self._front_mark(s, known[s.chunk]) for s in _first(queue, min(r.queue_seen, waiting))]
            downward = [Segment(s.chunk, s.round, -s.high, -s.low) for s in reversed(stack)]
            tops = [self._top_mark(s, known[s.chunk]) for s in _first(downward, min(r.stack_seen, free))]
            return (
                "some above",
                waiting if r.queue_end else None,
                waiting >= r.queue_seen,
                tuple(fronts),
                free if r.stack_end else None,
                free >= r.stack_seen,
                tuple(tops),
            )

        return look

    @staticmethod
    def _front_mark(s: Segment, r: Result) -> tuple:
        if s.round < 0:
            return s.chunk, "all", s.low, s.high
        return s.chunk, _mark(r.left_marks, s.high), s.low, s.high

    @staticmethod
    def _top_mark(s: Segment, r: Result) -> tuple:
        # s counts downward from zero at the bottom: the part lies between these depths below the top
        shallow, deep = r.free + s.low, r.free + s.high
        return s.chunk, _mark(r.free_marks, deep), shallow, deep


def _mark(found: list[str], units: int) -> str:
    """Digest that covers at least the first ``units``."""
    at = max(units - 1, 0).bit_length()
    return found[at] if at < len(found) - 1 else found[-1]


def _first(segments: Iterable[Segment], units: int) -> list[Segment]:
    out = []
    for s in segments:
        if units <= 0:
            break
        n = min(units, s.high - s.low)
        out.append(Segment(s.chunk, s.round, s.low, s.low + n))
        units -= n
    return out


def _drop_front(queue: deque[Segment], units: int) -> None:
    while units and queue:
        n = min(units, queue[0].high - queue[0].low)
        queue[0].low += n
        units -= n
        if queue[0].low == queue[0].high:
            queue.popleft()


def _drop_top(stack: list[Segment], units: int) -> None:
    while units and stack:
        n = min(units, stack[-1].high - stack[-1].low)
        stack[-1].high -= n
        units -= n
        if stack[-1].low == stack[-1].high:
            stack.pop()
