"""An append log of steps in a shared folder, and a ledger of what was handed on.

Appending puts a line in a buffer; a thread writes the buffer as one segment
every few hundredths of a second, so files grow with time, not with steps, and
the caller never waits for the folder.  A segment's name tells the offsets of
its lines: whoever opens the folder again goes on behind the last segment.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds between segments; bytes that a segment, and that the buffer, may have.
EVERY, SEGMENT, BUFFER = 0.05, 8 << 20, 64 << 20
_NAME = re.compile(r"(\d{15})-(\d+)-(\d+)\.json$")


class SharedFolder:
    """Files in a folder that Spark's own file systems reach, each there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path
        self._files.mkdirs(self._path(path))

    def write(self, name: str, text: str) -> None:
        """Write a file; one of that name from before stays if it is there."""
        hidden, shown = self._path(f"{self.path}/.{name}"), self._path(f"{self.path}/{name}")
        out = self._files.create(hidden, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        if not self._files.rename(hidden, shown) and not self._files.exists(shown):
            raise OSError(f"can't write {self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(name for s in self._files.listStatus(self._path(self.path)) if not (name := s.getPath().getName()).startswith((".", "_")))

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.path}/{name}"))

    def remove(self) -> None:
        self._files.delete(self._path(self.path), True)


class StepLog:
    """Lines in order, in segments ``{first offset}-{lines}-{mark}.json``.

    ``mark`` is a number that the writer gives with each line and that is read
    back when the log is opened again.  A log has one writer at a time.
    """

    def __init__(self, folder: SharedFolder, every: float = EVERY):
        self._folder, self._every = folder, every
        last = next((m for n in reversed(folder.names()) if (m := _NAME.search(n))), None)
        self.offset = int(last[1]) + int(last[2]) if last else 0
        self.mark = int(last[3]) if last else 0
        self._written = self.offset
        self._held: list[str] = []
        self._size, self._stop, self._now = 0, False, False
        self._error: Exception | None = None
        self._change = threading.Condition()
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def append(self, line: str, mark: int) -> int:
        """The offset of the line.  Waits only while the buffer is full."""
        with self._change:
            while self._size > BUFFER and not self._stop:
                self._change.wait(self._every)
            if self._stop:
                raise RuntimeError("the log is closed")
            self._held.append(line)
            self._size += len(line)
            self.mark = mark
            self.offset += 1
            if self._size > SEGMENT:
                self._change.notify_all()
            return self.offset - 1

    def flush(self, timeout: float = 60) -> None:
        """Wait until all that was appended is in segments."""
        until = time.monotonic() + timeout
        with self._change:
            to = self.offset
            self._now = True
            self._change.notify_all()
            while self._written < to:
                if time.monotonic() > until:
                    raise TimeoutError("the log can't be written") from self._error
                self._change.wait(0.05)

    def close(self) -> None:
        """Write what is left and end the thread."""
        try:
            self.flush()
        finally:
            with self._change:
                self._stop = True
                self._change.notify_all()
            self._thread.join()

    def _work(self) -> None:
        while True:
            with self._change:
                if not self._held or not self._now and self._size <= SEGMENT:
                    self._change.wait(self._every)
                self._now = False
                if not self._held:
                    if self._stop:
                        return
                    continue
                lines, mark, first = self._held, self.mark, self.offset - len(self._held)
                self._held, self._size = [], 0
            try:
                self._folder.write(f"{first:015d}-{len(lines)}-{mark}.json", "".join(lines))
                self._error = None
            except Exception as e:  # tried again, in order, with what comes meanwhile
                self._error = e
                with self._change:
                    self._held, self._size = lines + self._held, self._size + sum(map(len, lines))
                    if self._stop:
                        return
                time.sleep(self._every)
                continue
            with self._change:
                self._written = first + len(lines)
                self._change.notify_all()


class Ledger:
    """Which items of which batch were handed on, so that a batch that runs again hands on only the rest.

    An entry is written behind each hand-over.  Only an item that was handed on
    when its process ended before the entry was written is handed on twice.
    """

    def __init__(self, folder: SharedFolder):
        self._folder = folder

    def hand_on(self, batch: int, items, take: Callable) -> None:
        """Give ``take`` the items of a batch, in an order that is the same when it runs again."""
        if self._folder.exists(f"{batch:012d}-done"):
            return
        n = -1
        for n, item in enumerate(items):
            if not self._folder.exists(f"{batch:012d}-{n:09d}"):
                take(item)
                self._folder.write(f"{batch:012d}-{n:09d}", "")
        if n >= 0:
            self._folder.write(f"{batch:012d}-done", "")
