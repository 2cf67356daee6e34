"""Threshold detection on a stream of voltage blocks: the same events as in a batch, block after block.

A block is (channel, start, v array<double>). State keeps, for each channel, whether the last sample passed the
threshold, the last kept event and the next sample expected; blocks that come early wait in the state until those before
them are there, so late blocks change nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "channel int, sample long"
STATE = "held string"


def detect(blocks: DataFrame, threshold: float, skip: int) -> DataFrame:
    """(channel, sample) of upward crossings of |v| at least ``skip`` after the last kept one."""

    def run(key, frames, state):
        held = json.loads(state.get[0]) if state.exists else {"next": 0, "over": True, "last": None, "wait": []}
        wait = {int(s): v for s, v in held["wait"]}
        for pdf in frames:
            for start, v in zip(pdf["start"], pdf["v"], strict=True):
                if int(start) >= held["next"]:
                    wait[int(start)] = [float(x) for x in v]
        out = []
        while held["next"] in wait:
            start = held["next"]
            v = wait.pop(start)
            for i, x in enumerate(v):
                over = abs(x) > threshold
                if over and not held["over"] and (held["last"] is None or start + i - held["last"] >= skip):
                    out.append(start + i)
                    held["last"] = start + i
                held["over"] = over
            held["next"] = start + max(1, len(v))
        held["wait"] = sorted(wait.items())
        state.update((json.dumps(held),))
        yield pd.DataFrame({"channel": pd.Series([key[0]] * len(out), dtype="int32"), "sample": pd.Series(out, dtype="int64")})

    return blocks.groupBy("channel").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")
