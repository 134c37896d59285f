"""Batch model inference with a pluggable provider.

A *provider* is any object with a ``model_name`` and a
``complete(task, prompt) -> Response`` method; it is built once per task
partition from a picklable zero-argument factory, so clients, sessions and
connection pools are per executor task, never shipped from the driver.

``infer`` is a ``mapInArrow`` step: for each input row it calls the
provider once per task named in ``tasks`` (the prompts are columns
``prompt_<task>``), concurrently within the row when there are several
(an email and a summary overlap), with bounded transport retries for
transient failures.  A task holds the prompts and replies of a few
rows at a time (``HELD_BYTES`` of prompts), whatever its input.  It never raises for a row: each call yields content
or an error kind, plus token usage.  The provider instance is shared by the
``concurrency`` threads of its task, so it must be thread-safe (or use
``concurrency=1``).
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casegrid.schema import TRANSIENT_HTTP_STATUSES
from casegrid.session import bounded_batches

TRANSPORT_TRIES = 3
TRANSPORT_WAITS = (0.4, 0.8)
#: Prompt bytes of the rows that a task has under way, and of those it hands on
#: together; one row at least.
HELD_BYTES, PART_BYTES = 8 << 20, 1 << 20

USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")
TRANSIENT, PROVIDER, UNEXPECTED = "transient", "provider", "unexpected"


class ProviderError(Exception):
    """A failed provider call.  ``status`` is the HTTP status if any;
    ``kind`` may be ``connection`` or ``timeout``."""

    def __init__(self, message: str, *, status: int | None = None, kind: str | None = None):
        super().__init__(message)
        self.status = status
        self.kind = kind

    @property
    def transient(self) -> bool:
        return self.status in TRANSIENT_HTTP_STATUSES or self.kind in ("connection", "timeout")


@dataclass
class Response:
    content: str | None
    usage: Any = None  # object or dict with prompt/completion/total tokens


class Provider(Protocol):
    model_name: str

    def complete(self, task: str, prompt: str) -> Response: ...


ProviderFactory = Callable[[], Provider]

_FACTORIES: dict[str, ProviderFactory] = {}


def register_provider(name: str, factory: ProviderFactory) -> None:
    """Make a provider selectable by name."""
    _FACTORIES[name.strip().lower()] = factory


def provider_factory(name: str) -> ProviderFactory:
    """The factory registered under ``name``; an unknown name is refused
    before any job starts."""
    try:
        return _FACTORIES[name.strip().lower()]
    except KeyError:
        known = ", ".join(sorted(_FACTORIES)) or "none"
        raise ValueError(f"unknown provider {name!r}; registered: {known}") from None


# What a status means to the person who runs the job, by status.
STATUS_MESSAGES = {
    403: "access denied (403): check the key, and that it may use this model",
    404: "no such model (404): check its name",
    429: "too many requests (429): try again later",
}


def status_message(status: int | None, vendor: str = "Provider") -> str:
    """Human message for an HTTP status, or for a failure without one."""
    known = STATUS_MESSAGES.get(status or 0, f"call failed with status {status}" if status else "call failed")
    return f"{vendor}: {known}"


def _raw_usage(usage: Any) -> dict[str, Any]:
    """The three counts as the provider gave them, as text; what is no count
    is settled by ``aggregate.usage_rows``, in column expressions."""
    get = usage.get if isinstance(usage, dict) else lambda name: getattr(usage, name, None)
    return {name: None if (v := get(name)) is None else str(v) for name in USAGE_FIELDS}


def _attempt(provider: Provider, task: str, prompt: str) -> dict:
    """One try of one call.  Never raises."""
    out = {"content": None, "status": None, "error": None, "message": None, "tries": 0,
           "reported": False, **dict.fromkeys(USAGE_FIELDS)}
    try:
        resp = provider.complete(task, prompt)
    except ProviderError as exc:
        return out | {"status": exc.status, "error": TRANSIENT if exc.transient else PROVIDER,
                      "message": str(exc) or status_message(exc.status)}
    except Exception as exc:  # noqa: BLE001 - isolate any provider bug to its row
        return out | {"error": UNEXPECTED, "message": f"{type(exc).__name__}: {exc}"}
    content, usage = getattr(resp, "content", None), getattr(resp, "usage", None)
    out["content"] = None if content is None else str(content)
    if usage is not None:
        out.update(_raw_usage(usage), reported=True)
    return out


@dataclass
class _Part:
    """Calls taken up together: their size, their outcomes, and how many are open."""

    size: int
    out: list[dict]
    left: int


def call_parts(pool: ThreadPoolExecutor, slots: int, provider: Provider, parts: Iterable[tuple[int, list[tuple[float, str, str]]]],
               tries: int, waits: tuple[float, ...], sleep: Callable[[float], None], clock: Callable[[], float],
               most: int) -> Iterator[list[dict]]:
    """Outcomes of each of ``parts`` (size, calls (wait, task, prompt)), in their order.

    Calls wait in a queue by the time they are due: a call with a back-off, or
    one that failed for a passing reason and is to be tried again (U3), takes no
    thread and holds up no other call until then.  At most ``slots`` calls are
    in flight.  Parts are taken up while those not yet handed on have a size
    below ``most``, so a part's last calls do not hold up the next part's.  The
    task sleeps only when no call is in flight and none is due."""
    ahead = 0.0  # of the clock, where ``sleep`` returns early

    def now() -> float:
        return clock() + ahead

    source, more, held, number = iter(parts), True, 0, 0
    taken: deque[_Part] = deque()
    queue: list[tuple] = []  # (due, number, try, part, place in it, call)
    running: dict[Future, tuple] = {}
    while True:
        while more and (not taken or held < most):
            found = next(source, None)
            if found is None:
                more = False
                break
            size, calls = found
            part, began = _Part(size, [{}] * len(calls), len(calls)), now()
            for i, (delay, *call) in enumerate(calls):
                heapq.heappush(queue, (began + delay, number, 1, part, i, call))
                number += 1
            taken.append(part)
            held += size
        if not taken:
            return
        if not taken[0].left:
            part = taken.popleft()
            held -= part.size
            yield part.out
            continue
        while queue and len(running) < slots and queue[0][0] <= now():
            one = heapq.heappop(queue)
            running[pool.submit(_attempt, provider, *one[5])] = one
        if not running:
            due = queue[0][0]
            sleep(max(0.0, due - now()))  # the clock goes on between two looks at it
            ahead += max(0.0, due - now())
            continue
        next_due = max(0.0, queue[0][0] - now()) if queue and len(running) < slots else None
        for f in wait(running, timeout=next_due, return_when=FIRST_COMPLETED).done:
            _, n, t, part, i, call = running.pop(f)
            got = f.result() | {"tries": t}
            if got["error"] == TRANSIENT and t < tries:
                heapq.heappush(queue, (now() + waits[min(t - 1, len(waits) - 1)], n, t + 1, part, i, call))
            else:
                part.out[i] = got
                part.left -= 1


def run_calls(pool: ThreadPoolExecutor, slots: int, provider: Provider, calls: list[tuple[float, str, str]], tries: int,
              waits: tuple[float, ...], sleep: Callable[[float], None], clock: Callable[[], float]) -> list[dict]:
    """Outcomes of ``calls`` (wait, task, prompt), in their order, all taken up at once."""
    return next(call_parts(pool, slots, provider, [(0, calls)], tries, waits, sleep, clock, 1))


def runs(batch: pa.RecordBatch, columns: list[str], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``batch`` in slices of whole rows with at most ``most`` bytes of text in
    ``columns`` (a longer row is one by itself), each with its bytes."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield int(ends[end - 1]) - before, batch.slice(at, end - at)
        at = end


_RESULT_FIELDS = (
    ("content", T.StringType()),
    ("status", T.IntegerType()),
    ("error", T.StringType()),
    ("message", T.StringType()),
    ("tries", T.IntegerType()),
    ("reported", T.BooleanType()),
    *((name, T.StringType()) for name in USAGE_FIELDS),
)
_ARROW_TYPES = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}


def infer_schema(df: DataFrame, tasks: Iterable[str]) -> T.StructType:
    tasks = list(tasks)
    keep = [f for f in df.schema.fields if f.name not in {f"prompt_{t}" for t in tasks} | {"wait_s"}]
    extra = [T.StructField(f"{t}_{name}", typ) for t in tasks for name, typ in _RESULT_FIELDS]
    return T.StructType(keep + extra + [T.StructField("model", T.StringType())])


def infer(prompts: DataFrame, factory: ProviderFactory, tasks: tuple[str, ...], *,
          tries: int = TRANSPORT_TRIES, waits: tuple[float, ...] = TRANSPORT_WAITS,
          sleep: Callable[[float], None] = time.sleep, concurrency: int = 4,
          clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """Run the provider over ``prompt_<task>`` columns; other columns pass
    through.  A ``wait_s`` column asks for a back-off before the row's
    first calls (retry passes after transient failures)."""
    bounded_batches(prompts.sparkSession)
    schema = infer_schema(prompts, tasks)
    keep = [f.name for f in prompts.schema.fields
            if f.name not in {f"prompt_{t}" for t in tasks} | {"wait_s"}]
    names = schema.names

    asked = [f"prompt_{t}" for t in tasks]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        model = getattr(provider, "model_name", None)
        slots = max(1, concurrency)
        kept: deque[list[pa.Array]] = deque()  # of the parts under way

        def parts() -> Iterator[tuple[int, list[tuple[float, str, str]]]]:
            for batch in batches:
                for size, part in runs(batch, asked, PART_BYTES):
                    kept.append([part.column(c) for c in keep])
                    delays = part.column("wait_s").to_pylist() if "wait_s" in part.schema.names else [0.0] * part.num_rows
                    texts = zip(*[part.column(c).to_pylist() for c in asked], strict=True)
                    # Row by row, so that the calls of one row overlap.
                    yield size, [(float(d or 0.0), t, p) for d, row in zip(delays, texts, strict=True) for t, p in zip(tasks, row, strict=True)]

        with ThreadPoolExecutor(max_workers=slots) as pool:
            for done in call_parts(pool, slots, provider, parts(), tries, waits, sleep, clock, HELD_BYTES):
                cols = kept.popleft()
                cols += [pa.array([r[name] for r in done[i::len(tasks)]], _ARROW_TYPES[typ])
                         for i in range(len(tasks)) for name, typ in _RESULT_FIELDS]
                cols.append(pa.array([model] * (len(done) // len(tasks)), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return prompts.mapInArrow(fn, schema)
