"""An external program for each record, with its exit code, output, errors and time in columns."""

from __future__ import annotations

import os
import selectors
import signal
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

RESULT = "stdout string, stderr string, exitcode int, signal int, timed_out boolean, seconds double"


class Process:
    """A running program in a process group of its own, fed and read without ever waiting beyond a time."""

    def __init__(self, argv: list[str]):
        self.p = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, bufsize=0)
        for f in (self.p.stdin, self.p.stdout, self.p.stderr):
            os.set_blocking(f.fileno(), False)
        self.open = {self.p.stdout, self.p.stderr}

    def exchange(self, data: bytes, end: float, close: bool) -> tuple[bytes, bytes, bool]:
        """(output, errors, whether it was in time): sends the data, and reads until the program ends, or up to the first line of output where `close` is not set."""
        out, err, left = bytearray(), bytearray(), memoryview(data)
        with selectors.DefaultSelector() as events:
            for f in self.open:
                events.register(f, selectors.EVENT_READ)
            if left:
                events.register(self.p.stdin, selectors.EVENT_WRITE)
            elif close:
                self.p.stdin.close()
            while self.open and (close or b"\n" not in out):
                ready = events.select(max(0.0, end - time.monotonic()))
                if not ready:
                    return bytes(out), bytes(err), False
                for key, _ in ready:
                    if key.fileobj is self.p.stdin:
                        try:
                            left = left[os.write(self.p.stdin.fileno(), left[:65536]) :]
                        except BrokenPipeError:  # it ended without reading all
                            left = left[:0]
                        if not left:
                            events.unregister(self.p.stdin)
                            if close:
                                self.p.stdin.close()
                    elif got := os.read(key.fileobj.fileno(), 1 << 16):
                        (out if key.fileobj is self.p.stdout else err).extend(got)
                    else:
                        events.unregister(key.fileobj)
                        self.open.discard(key.fileobj)
        return bytes(out), bytes(err), True

    def ended(self, end: float) -> int | None:
        """The return code, if it ends in time."""
        try:
            return self.p.wait(max(0.01, end - time.monotonic()))
        except subprocess.TimeoutExpired:
            return None

    def stop(self) -> None:
        """Ends the program and what it has started."""
        try:
            os.killpg(self.p.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        self.p.wait()
        for f in (self.p.stdin, self.p.stdout, self.p.stderr):
            f.close()


def run_command(records: DataFrame, argv: list[str], stdin: str, timeout: float = 60.0, keep: bool = False, parts: int | None = None) -> DataFrame:
    """The records with the columns of RESULT, from a program that gets the text of column `stdin` (null: empty).

    By default each record has a process of its own, which ends at the end of its input. With `keep` a task keeps one process for its records,
    each of which is sent as a line and answered by a line; where the process ends or takes too long, its record says so and the next one
    gets a new process, so no record is lost or repeated. Every record keeps its row: exitcode is the program's, or null where it was
    ended by a signal, which is then named, or by the time limit. Programs that are not found give exit code 127, as in a shell.
    With `parts` the records are first dealt out to so many tasks, since a file that is small to read may hold hours of work; else they stay in
    their partitions. Results replace columns of the same name. Records of several lines cannot be sent to a kept process: exit code null and a word in stderr.
    """
    made = StructType.fromDDL(RESULT)
    names = made.fieldNames()
    kept = [f for f in records.schema.fields if f.name not in names]
    shown = lambda b: b.decode("utf-8", "replace")

    def outcome(code: int | None, out: bytes, err: bytes, late: bool, began: float) -> tuple:
        return shown(out), shown(err), code if code is not None and code >= 0 and not late else None, -code if code is not None and code < 0 and not late else None, late, time.monotonic() - began

    def alone(text: str, began: float) -> tuple:
        process = Process(argv)
        try:
            out, err, whole = process.exchange(text.encode(), began + timeout, close=True)
            code = process.ended(began + timeout) if whole else None
            return outcome(code, out, err, code is None, began)
        finally:
            process.stop()

    class Kept:
        process: Process | None = None

        def answer(self, text: str, began: float) -> tuple:
            if "\n" in text:
                return "", "a record of several lines needs a process of its own", None, None, False, 0.0
            self.process = self.process or Process(argv)
            out, err, whole = self.process.exchange(f"{text}\n".encode(), began + timeout, close=False)
            if whole and b"\n" in out:
                return outcome(0, out.rstrip(b"\r\n"), err, False, began)
            code = self.process.ended(began + timeout) if whole else None
            self.stop()
            return outcome(code, out, err, code is None, began)

        def stop(self) -> None:
            if self.process:
                self.process.stop()
            self.process = None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Kept()
        try:
            for frame in frames:
                rows = []
                for text in frame[stdin]:
                    began = time.monotonic()
                    try:
                        rows.append((worker.answer if keep else alone)("" if text is None else str(text), began))
                    except FileNotFoundError as e:
                        rows.append(("", str(e), 127, None, False, 0.0))
                found = pd.DataFrame(rows, columns=names, index=frame.index, dtype=object)
                yield pd.concat([frame[[f.name for f in kept]], found], axis=1)
        finally:
            worker.stop()

    dealt = records.repartition(parts) if parts else records
    return dealt.mapInPandas(run, StructType([*kept, *made.fields]))
