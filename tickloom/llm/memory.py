"""Values remembered for strings, in bounded memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Collection

import pyarrow as pa

ENTRY = 200  # bytes of an entry besides its characters and its value, about


class Memory:
    """Two generations of at most `most_bytes` each, or one batch of keys if that is more.

    When the present one is full it becomes the former one, whose values move on as they are met
    again; what isn't met for a generation is forgotten.
    """

    def __init__(self, most_bytes: int, fixed: dict[str, bytes] | None = None):
        self.most, self.fixed = most_bytes, fixed or {}
        self.forget()

    def forget(self) -> None:
        self.now, self.former, self.bytes = dict(self.fixed), {}, 0

    def turn(self) -> None:
        """To be called between batches: a full generation gives way to a new one."""
        if self.bytes > self.most:
            self.now, self.former, self.bytes = dict(self.fixed), self.now, 0

    def missing(self, keys: Collection[str]) -> list[str]:
        """Keys without a value; the values of all others are in `now` afterwards."""
        unmet = [k for k in keys if k not in self.now]
        if not self.former:
            return unmet
        again = {k: self.former[k] for k in unmet if k in self.former}
        self.add(again)
        return [k for k in unmet if k not in again]

    def add(self, values: dict[str, bytes]) -> None:
        self.now.update(values)
        self.bytes += sum(map(len, values.keys())) + sum(map(len, values.values())) + ENTRY * len(values)


def give_back() -> None:
    """Return freed memory to the machine. Idle Python workers live on for a minute beside whatever runs next in their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
