"""Time operators per key. Those with a state that depends on what was emitted before run as one state machine in a grouped map on tables and as a stateful query on streams, with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def aligned_windows(df: DataFrame, size: str, keys: Sequence[str], measures: Sequence, ts: str = "ts", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows on the clock; with `late`, a watermark, so that a stream closes them. Works on tables and streams."""
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(*measures)
    return out.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def sessions(df: DataFrame, gap: str, keys: Sequence[str], measures: Sequence, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Windows that end after a gap without rows."""
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.session_window(ts, gap), *keys).agg(*measures)
    return out.withColumns({"window_start": F.col("session_window.start"), "window_end": F.col("session_window.end")}).drop("session_window")


def debounce(df: DataFrame, quiet_seconds: float, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows with no other of their key in the quiet time after them, and each key's last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.lead(_micros(ts)).over(w) - _micros(ts)
    return df.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= int(quiet_seconds * 1e6))).drop("__gap")


def _machine(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, step: Callable[[list[int]], list[int]], out: str) -> DataFrame:
    """A column of numbers that a scan over a key's ordered times gives. Only times and order columns go to Python, in Arrow batches of a key."""
    slim = df.select(*dict.fromkeys([*keys, *order]), _micros(ts).alias("__t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.assign(**{out: step(pdf["__t"].tolist())}).drop(columns="__t")

    schema = ", ".join(f"`{n}` {t}" for n, t in slim.drop("__t").dtypes) + f", `{out}` long"
    marks = slim.groupBy(*keys).applyInPandas(run, schema)
    return df.join(marks, list(dict.fromkeys([*keys, *order])))


def throttle(df: DataFrame, seconds: float, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows at least so long after the last one kept of their key. keys and order together tell rows apart."""
    size = int(seconds * 1e6)

    def step(times: list[int]) -> list[int]:
        last, out = None, []
        for t in times:
            kept = last is None or t - last >= size
            last = t if kept else last
            out.append(int(kept))
        return out

    return _machine(df, keys, order, ts, step, "__kept").where("__kept = 1").drop("__kept")


def sampled(df: DataFrame, seconds: float, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """A key's row whenever the interval has passed since the last one kept, counted from its first row, and its last row if that is still due."""
    size = int(seconds * 1e6)

    def step(times: list[int]) -> list[int]:
        last, out = times[0] if times else None, []
        for t in times:
            kept = t - last >= size
            last = t if kept else last
            out.append(int(kept))
        if out:
            out[-1] = 1
        return out

    return _machine(df, keys, order, ts, step, "__kept").where("__kept = 1").drop("__kept")


def anchored_windows(df: DataFrame, seconds: float, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Column window: tumbling windows of a key, each beginning with the first row after the one before has closed."""
    size = int(seconds * 1e6)

    def step(times: list[int]) -> list[int]:
        start, n, out = None, -1, []
        for t in times:
            if start is None or t - start >= size:
                start, n = t, n + 1
            out.append(n)
        return out

    return _machine(df, keys, order, ts, step, "window")


def count_or_time_batches(df: DataFrame, count: int, seconds: float, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Column batch: a key's batch closes with the row that fills it or that comes so long after its first."""
    size = int(seconds * 1e6)

    def step(times: list[int]) -> list[int]:
        start, held, n, out = None, 0, 0, []
        for t in times:
            start = t if start is None else start
            held += 1
            out.append(n)
            if held >= count or t - start >= size:
                start, held, n = None, 0, n + 1
        return out

    return _machine(df, keys, order, ts, step, "batch")


def throttle_stream(stream: DataFrame, seconds: float, key: str, ts: str = "ts") -> DataFrame:
    """throttle on a stream: the time last kept is each key's state. Rows of a trigger are taken in the order of their times."""
    size = int(seconds * 1e6)
    names = stream.columns

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(ts, kind="stable")
        kept = []
        for t in pdf[ts].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last >= size
            last = t if ok else last
            kept.append(ok)
        if last is not None:
            state.update((int(last),))
        yield pdf[kept][names]

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Each trigger's rows are merged into a new version of the table under path (v=0, v=1, ...); a trigger that is run again writes the same version again. path is any Hadoop URI."""
    from graphloom.operators.writes import latest, upsert

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        target = spark.read.parquet(f"{path.rstrip('/')}/v={n - 1}") if n else None
        new = latest(batch, keys, order) if target is None else upsert(target, batch, keys, order)
        new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
