"""Recordings on storage: NumPy and raw binary files in, Parquet tables between stages, pickles out.

Raw files are cut into blocks by byte ranges, so that one file is read by many tasks; the driver makes the list of ranges
from the file's length alone. Spark tables are the exchange format of everything after.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SAMPLES = 1 << 18
VOLTAGE = "rec_id string, channel int, sample long, v float"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def npy_layout(path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(dtype, shape, Fortran order, bytes before the data) from a file's header."""
    files, where = _filesystem(path)
    with files.open_input_file(where) as source:
        version = np.lib.format.read_magic(source)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
        return dtype, shape, fortran, source.tell()


def read_voltage(spark: SparkSession, path: str, rec_id: str, channels: int | None = None, dtype: str | None = None) -> DataFrame:
    """(rec_id, channel, sample, v) of a ``.npy`` or ``.bin`` file of channels x samples; a single row is one channel."""
    if path.endswith(".npy"):
        kind, shape, fortran, offset = npy_layout(path)
        shape = shape if len(shape) == 2 else (1, *shape)
        if fortran and shape[0] > 1:
            raise ValueError("voltage must be stored channel by channel")
        if channels is not None and channels != shape[0]:
            raise ValueError(f"the file holds {shape[0]} channels, not {channels}")
    elif path.endswith(".bin"):
        if dtype is None or channels is None:
            raise ValueError("a raw file needs dtype and channels")
        files, where = _filesystem(path)
        kind, offset = np.dtype(dtype), 0
        shape = (channels, files.get_file_info(where).size // kind.itemsize // channels)
    else:
        raise ValueError(f"not a voltage file: {path}")
    n = shape[1]
    ranges = spark.range(shape[0]).select(F.col("id").cast("int").alias("channel"), F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // BLOCK_SAMPLES)))).alias("block"))
    name, size = kind.str, kind.itemsize

    def run(batches):
        files, where = _filesystem(path)
        with files.open_input_file(where) as source:
            for pdf in batches:
                for channel, block in zip(pdf["channel"], pdf["block"], strict=True):
                    first = block * BLOCK_SAMPLES
                    count = min(BLOCK_SAMPLES, n - first)
                    v = np.frombuffer(source.read_at(count * size, offset + (channel * n + first) * size), name).astype(np.float32)
                    yield pd.DataFrame({"rec_id": rec_id, "channel": np.int32(channel), "sample": np.arange(first, first + count), "v": v})

    blocks = shape[0] * max(1, -(-n // BLOCK_SAMPLES))
    return ranges.repartition(min(blocks, 10_000)).mapInPandas(run, VOLTAGE)


def get_voltage(voltage: DataFrame, channels: list[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A slice by channels and a half-open range of samples; both reach the scan as pushed filters."""
    out = voltage if channels is None else voltage.where(F.col("channel").isin(channels))
    out = out if start is None else out.where(F.col("sample") >= start)
    return out if end is None else out.where(F.col("sample") < end)


def set_voltage(voltage: DataFrame, new: DataFrame) -> DataFrame:
    """``voltage`` with the values of ``new`` (channel, sample, v) laid over it."""
    over = new.select("channel", "sample", F.col("v").alias("__v"), F.lit(True).alias("__set"))
    kind = voltage.schema["v"].dataType
    return voltage.join(over, ["channel", "sample"], "left").withColumn("v", F.when(F.col("__set"), F.col("__v").cast(kind)).otherwise(F.col("v"))).select(*voltage.columns)


def write_stage(df: DataFrame, path: str, by: tuple[str, ...] = ("seg",)) -> DataFrame:
    """Write a stage's table, partitioned where it has the columns, and read it again."""
    keys = [k for k in by if k in df.columns]
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Recording:
    """Voltage (channel, sample, v) with its sampling rate, number of channels and neighbor table; each change is a new
    recording."""

    voltage: DataFrame
    fs: int
    channels: int
    neighbors: DataFrame

    @property
    def n_samples(self) -> int:
        return int(self.voltage.agg(F.coalesce(F.max("sample") + 1, F.lit(0))).first()[0])

    def get(self, channels: list[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        return get_voltage(self.voltage, channels, start, end)

    def set(self, new: DataFrame) -> Recording:
        return replace(self, voltage=set_voltage(self.voltage, new))

    def with_voltage(self, voltage: DataFrame) -> Recording:
        """Another voltage on the same probe; its channels must be those of the probe."""
        names = sorted(r.channel for r in voltage.select("channel").distinct().limit(self.channels + 1).collect())
        if names != list(range(self.channels)):
            raise ValueError(f"voltage has channels {names}, the probe has {self.channels}")
        return replace(self, voltage=voltage)

    def bandpass(self, low: float, high: float) -> Recording:
        from fluxweave.operators import filters

        return replace(self, voltage=filters.bandpass(self.voltage, low, high, self.fs))


def _write(path: str, value, protocol: int | None = None) -> None:
    files, where = _filesystem(path)
    with files.open_output_stream(where) as sink:
        sink.write(pickle.dumps(value, protocol))


def write_pickle(neurons: DataFrame, path: str) -> None:
    """The finished neurons as one pickle for a viewer; their number is bounded by what a person looks at."""
    _write(path, [r.asDict(recursive=True) for r in neurons.toLocalIterator()])


def viewer_path(path: str) -> str:
    """Where a viewer's copy of a neurons' file is put: beside it, with ``_viz``."""
    stem, dot, kind = path.rpartition(".")
    return (stem if dot and kind in ("pkl", "pickle") else path) + "_viz.pkl"


def write_viewer(neurons: DataFrame, path: str, fs: int, filename: str = "default_fname", only: bool = True) -> None:
    """Neurons (channel, samples, ..) as a pickle for a viewer that counts channels and samples from one; the first channel
    stands for the neuron. ``only``: just the viewer's keys, else with all columns. No neurons is an error."""
    out = []
    for r in neurons.toLocalIterator():
        row = r.asDict(recursive=True)
        channel, samples = row["channel"][0] + 1, np.array(row["samples"], dtype=np.uint32) + 1
        # The viewer's keys.
        keys = {
            "spike_indices__": samples, "filename__": filename, "channel_id__": np.array(channel, dtype=np.uint16),
            "spike_indices_channel__": np.full(samples.shape, channel, dtype=np.uint16), "type__": "Neuron", "sampling_rate__": fs,
        }
        out.append(keys if only else {**row, **keys})
    if not out:
        raise ValueError("no neurons")
    _write(path, out, 3)  # other languages' readers know protocol 3


def delete_clips(df: DataFrame) -> DataFrame:
    return df.drop("clip")
