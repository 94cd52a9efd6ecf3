"""Run statistics: durations, counts, store size, and the benchmark lines."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Timer:
    """Named durations in nanoseconds."""

    ns: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str):
        start = time.perf_counter_ns()
        try:
            yield
        finally:
            self.ns[name] = self.ns.get(name, 0) + time.perf_counter_ns() - start

    def total(self) -> int:
        return sum(self.ns.values())


def store_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and files of a store, in any file system that Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    summary = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    return summary.getLength(), summary.getFileCount()


@contextmanager
def measured(spark: SparkSession, name: str):
    """Collects the stages of the jobs that run inside: a list of ``Stage`` after the block."""
    sc, group, stages = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", []
    sc.setJobGroup(group, name)
    try:
        yield stages
    finally:
        sc._jsc.clearJobGroup()
        store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
        ids = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
        for i in sorted(ids):
            info = tracker.getStageInfo(i)
            data = store.lastStageAttempt(i) if info and info.numCompletedTasks else None  # a reused stage has no attempt
            if data is None or data.completionTime().isEmpty():
                continue
            wall = data.completionTime().get().getTime() - data.submissionTime().get().getTime()
            stages.append(Stage(i, data.numTasks(), wall * 10**6, data.executorRunTime() * 10**6, data.shuffleReadBytes(), data.shuffleWriteBytes(), data.outputBytes()))


@dataclass
class Stage:
    """A stage as Spark's status store has it: wall time and the sum of its tasks' times in nanoseconds, and bytes."""

    id: int
    tasks: int
    wall_ns: int
    run_ns: int
    read: int
    shuffled: int
    written: int


def writer_line(stages: list[Stage], total_ns: int, packets: int, size: int, files: int) -> str:
    """One ingest run: six stage durations, then total duration, time a packet, packets a second, packets, bytes, bytes a packet, files.

    Spark runs reading with conversion, and sorting, compression and aggregation with writing, as one stage each: the first and the
    last of the six are their measured wall times, the others stay empty.
    """
    reading = sum(s.wall_ns for s in stages if s.shuffled and not s.read)
    writing = sum(s.wall_ns for s in stages if s.written and s.read)
    return f"{reading};;;;;{writing};{total_ns};{total_ns // max(1, packets)};{packets * 10**9 // max(1, total_ns)};{packets};{size};{size / max(1, packets):.4f};{files}"


def reader_line(handling_ns: int, writing_ns: int) -> str:
    """One query: time until all packets are read and filtered, time of the output after that, and the sum."""
    return f"{handling_ns};{writing_ns};{handling_ns + writing_ns}"
