"""Flow cytometry standard files: a reader and a writer for the binary format."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FcsError(ValueError):
    """The file isn't a readable FCS file."""


@dataclass
class FcsEvents:
    names: list[str]
    descriptions: list[str]
    values: np.ndarray
    text: dict[str, str]

    def channel(self, name: str) -> np.ndarray:
        if name not in self.names:
            raise KeyError(f"no channel {name}; there are {', '.join(self.names)}")
        return self.values[:, self.names.index(name)]

    def ranges(self) -> dict[str, float]:
        out = {}
        for k, n in enumerate(self.names):
            try:
                out[n] = float(self.text[f"$p{k + 1}r"])
            except (KeyError, ValueError):
                out[n] = math.nan
        return out


def parse(data: bytes) -> FcsEvents:
    """All channels of list-mode data in original order, raw, as float64; keywords in lower case."""
    if len(data) < 58 or not data.startswith(b"FCS"):
        raise FcsError("no FCS header")
    try:
        t0, t1, d0, d1 = (int(data[10 + 8 * k : 18 + 8 * k]) for k in range(4))
        raw = data[t0 : t1 + 1].decode("utf-8", "replace")
        mark = raw[0]
        fields = raw[1:].replace(mark * 2, "\0").split(mark)
        fields = [f.replace("\0", mark) for f in fields]
        text = {k.strip().lower(): v.strip() for k, v in zip(fields[::2], fields[1::2], strict=False)}
        if not d0:
            d0, d1 = int(text["$begindata"]), int(text["$enddata"])
        n, width = int(text["$tot"]), int(text["$par"])
        order = "<" if text["$byteord"].startswith("1") else ">"
        kind = text["$datatype"].upper()
        bits = [int(text[f"$p{k + 1}b"]) for k in range(width)]
        codes = ["f4" if kind == "F" else "f8" if kind == "D" else f"u{b // 8}" for b in bits]
        table = np.frombuffer(data[d0 : d1 + 1], dtype=np.dtype([(str(k), order + c) for k, c in enumerate(codes)]), count=n)
    except (KeyError, IndexError, ValueError) as e:
        raise FcsError(f"damaged FCS file: {e}") from e
    values = np.stack([table[str(k)].astype(np.float64) for k in range(width)], axis=1) if width else np.empty((n, 0))
    if kind == "I":
        for k in range(width):
            top = float(text.get(f"$p{k + 1}r", 0) or 0)
            if top and top < 2 ** bits[k]:
                values[:, k] = np.mod(values[:, k], 2 ** math.ceil(math.log2(top)))
    return FcsEvents([text.get(f"$p{k + 1}n", "") for k in range(width)], [text.get(f"$p{k + 1}s", "") for k in range(width)], values, text)


#: Keywords that the writer sets itself.
_STRUCTURAL = ("$beginanalysis", "$endanalysis", "$beginstext", "$endstext", "$begindata", "$enddata", "$byteord", "$datatype", "$mode", "$nextdata", "$par", "$tot")


def write(events: FcsEvents, mask: np.ndarray | None = None, extra: dict[str, np.ndarray] | None = None, extra_range: float = 20000.0) -> bytes:
    """Masked events and extra channels as 32-bit floats; other keywords are kept."""
    extra = extra or {}
    if dup := set(extra) & set(events.names):
        raise ValueError(f"channels exist: {sorted(dup)}")
    if any(len(v) != len(events.values) for v in extra.values()) or (mask is not None and len(mask) != len(events.values)):
        raise ValueError("a mask or channel of another length")
    values = np.column_stack([events.values, *extra.values()]) if extra else events.values
    values = values if mask is None else values[np.asarray(mask, dtype=bool)]
    names = [*events.names, *extra]
    own = {"$byteord": "1,2,3,4", "$datatype": "F", "$mode": "L", "$nextdata": "0", "$par": str(len(names)), "$tot": str(len(values)), "$beginanalysis": "0", "$endanalysis": "0", "$beginstext": "0", "$endstext": "0"}
    old = events.ranges()
    for k, n in enumerate(names):
        top = old.get(n, math.nan)
        own |= {f"$p{k + 1}n": n, f"$p{k + 1}b": "32", f"$p{k + 1}e": "0,0", f"$p{k + 1}r": f"{extra_range if n in extra else 262144.0 if top != top else top:g}"}
        if k < len(events.descriptions) and events.descriptions[k]:
            own[f"$p{k + 1}s"] = events.descriptions[k]
    text = {k: v for k, v in events.text.items() if v and k not in _STRUCTURAL} | own
    body = values.astype("<f4").tobytes()

    def encoded(begin: int) -> bytes:
        full = text | {"$begindata": f"{begin:020d}", "$enddata": f"{begin + max(len(body) - 1, 0):020d}"}
        return ("/" + "/".join(x.replace("/", "//") for kv in full.items() for x in (kv[0].upper(), kv[1])) + "/").encode("utf-8")

    t0 = 256
    d0 = t0 + len(encoded(0))
    head = f"FCS3.1    {t0:8d}{d0 - 1:8d}"
    ends = f"{d0:8d}{d0 + max(len(body) - 1, 0):8d}" if d0 + len(body) < 100_000_000 else f"{0:8d}{0:8d}"
    return (head + ends + f"{0:8d}{0:8d}").encode().ljust(t0) + encoded(d0) + body


def read(spark: SparkSession, path: str, channels: Sequence[str], pattern: str = "*.[fF][cC][sS]") -> DataFrame:
    """Rows (source_filename, event_no, channels...) of all files of a folder; a file is decoded in one task.

    Damaged files give one row with `error` and no event, so the others can be used.
    """
    channels = list(channels)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    ev = parse(bytes(content))
                    if not len(ev.values):
                        raise FcsError("no events")
                    cols = {c: ev.channel(c) for c in channels}
                except (FcsError, KeyError) as e:
                    yield pd.DataFrame({"source_filename": [name], "event_no": [None], "error": [str(e)], **{c: [None] for c in channels}})
                    continue
                for a in range(0, len(ev.values), 100_000):
                    n = len(ev.values[a : a + 100_000])
                    yield pd.DataFrame({"source_filename": name, "event_no": np.arange(a, a + n), "error": None, **{c: v[a : a + n] for c, v in cols.items()}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    schema = "source_filename string, event_no long, error string, " + ", ".join(f"`{c}` double" for c in channels)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").mapInPandas(decode, schema)
