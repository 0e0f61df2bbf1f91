"""Data sources of the engine for ``spark.read.format`` and ``df.write.format``.

``wavelark_ringing`` reads the synthetic series in parts; ``wavelark_figures`` writes a page with a figure for each series from the
rows that the plots give. Register both by ``register(spark)``.
"""

from __future__ import annotations

import html
import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The primes of the public 64-bit hash.
PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(ids: np.ndarray, seed: int) -> np.ndarray:
    """``xxhash64(id, seed)`` of whole numbers and a 32-bit one, as Spark's function of that name: each column's hash is the
    seed of the next one's."""
    p = [np.uint64(x) for x in PRIMES]

    def finish(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p[1]
        x = (x ^ (x >> np.uint64(29))) * p[2]
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        x = np.uint64(42) + p[4] + np.uint64(8)
        x = x ^ (_turned(ids.astype(np.uint64) * p[1], 31) * p[0])
        x = finish(_turned(x, 27) * p[0] + p[3])
        x = x + p[4] + np.uint64(4)
        x = x ^ (np.uint64(seed & 0xFFFFFFFF) * p[0])
        return finish(_turned(x, 23) * p[1] + p[2]).astype(np.int64)


@dataclass
class Stretch(InputPartition):
    first: int
    stop: int


class RingingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.samples, self.strike, self.seed = (int(options.get(k, d)) for k, d in (("samples", 6000), ("strike", 2450), ("seed", 3)))
        self.parts = int(options.get("partitions", 8))
        if self.samples < 0 or self.parts < 1:
            raise ValueError("samples is 0 or more, partitions is 1 or more")

    def partitions(self) -> Sequence[Stretch]:
        cuts = [self.samples * k // self.parts for k in range(self.parts + 1)]
        return [Stretch(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.stop, 65_536):
            i = np.arange(first, min(first + 65_536, partition.stop))
            i = i[i != 31]
            order = i
            if first == partition.first and partition.stop == self.samples > 50:  # the last part has the sample that comes twice
                i, order = np.append(i, 50), np.append(order, self.samples)
            since = (i - self.strike).astype(float)
            noise = (hashed(i, self.seed) % 2001 - 1000) / 10_000
            hum = np.sin(i * (2 * math.pi / 40)) + 0.3 * np.sin(i * (2 * math.pi / 11))
            ring = np.where((since >= 0) & (since < 400), 6 * np.exp(-np.maximum(since, 0) / 60) * np.sin(since * (2 * math.pi / 7)), 0)
            value = np.where(order == self.samples, -77.0, hum + ring + noise)
            start = datetime(2025, 3, 1, 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array([start + timedelta(seconds=int(x)) for x in i], pa.timestamp("us")), pa.array(value, mask=i % 997 == 996), pa.array(np.where(i % 1009 == 1008, "poor", "good").tolist()), pa.array(order)],
                ["time", "value", "quality", "ord"],
            )


class Ringing(DataSource):
    """The rows of ``series.ringing``, in parts; options samples, strike, seed and partitions."""

    @classmethod
    def name(cls) -> str:
        return "wavelark_ringing"

    def schema(self) -> str:
        return "time timestamp_ntz, value double, quality string, ord long"

    def reader(self, schema) -> RingingReader:
        return RingingReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}canvas{{border:1px solid #ccc;display:block;margin-bottom:1em}}</style><h1>{title}</h1><script>
const panels=new Map();function add(row,title,trace,x,y,z){{const k=row+"|"+title;if(!panels.has(k))panels.set(k,new Map());const p=panels.get(k);if(!p.has(trace))p.set(trace,[]);p.get(trace).push([x,y,z])}}
"""
DRAW = """
const ink=["#1f5f99","#2a8c4a","#c0392b","#8a5a00","#555"];
for(const [k,traces] of panels){const h=document.createElement("h2");h.textContent=k.slice(k.indexOf("|")+1);document.body.append(h);
const c=document.createElement("canvas");c.width=960;c.height=260;document.body.append(c);const g=c.getContext("2d");const all=[...traces.values()].flat();
const ext=j=>{let a=Infinity,b=-Infinity;for(const p of all){const v=p[j];if(v!==null){a=Math.min(a,v);b=Math.max(b,v)}}return a<b?[a,b]:[a-1,a+1]};
const [x0,x1]=ext(0),[y0,y1]=ext(1),[z0,z1]=ext(2);const X=v=>10+(v-x0)/(x1-x0)*940,Y=v=>250-(v-y0)/(y1-y0)*240;let n=0;
for(const [name,points] of traces){g.fillStyle=g.strokeStyle=ink[n%5];if(points.some(p=>p[2]!==null)){for(const p of points){g.fillStyle="hsl(220,70%,"+(95-70*(p[2]-z0)/(z1-z0))+"%)";g.fillRect(X(p[0])-3,Y(p[1])-3,6,6)}}
else{points.sort((a,b)=>a[0]-b[0]);if(name==="observed"||name==="interpolated"){for(const p of points)if(p[1]!==null)g.fillRect(X(p[0])-2,Y(p[1])-2,4,4)}else{g.beginPath();points.forEach((p,i)=>i?g.lineTo(X(p[0]),Y(p[1])):g.moveTo(X(p[0]),Y(p[1])));g.stroke()}}
g.fillStyle=ink[n%5];g.fillText(name,20,20+14*n);n++}}
</script>"""


class FigureWriter(DataSourceWriter):
    """Writes pages into a folder of the task; commit moves them to their place, abort leaves nothing."""

    def __init__(self, options: dict, schema) -> None:
        if "path" not in options:
            raise ValueError("figures need a path")
        self.path = options["path"].rstrip("/")
        self.keys = [k for k in options.get("series", "").split(",") if k]
        self.names = schema.fieldNames()
        lost = [c for c in [*self.keys, "plot_row", "title", "trace", "y"] if c not in self.names]
        if lost:
            raise ValueError(f"rows of figures lack {lost}")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._open()
        folder, names = f"{root}/_temporary/{uuid.uuid4().hex}", []
        files.create_dir(folder)
        page, series = None, None
        try:
            for row in iterator:
                own = tuple(row[k] for k in self.keys)
                if page is None or own != series:
                    if page is not None:
                        self._close(page)
                    series, told = own, ", ".join(map(str, own))
                    title = " — ".join(x for x in (row["figure_title"] if "figure_title" in self.names else row["title"], told) if x)
                    names.append("".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in told) + ".html" if own else "figure.html")
                    page = files.open_output_stream(f"{folder}/{names[-1]}")
                    page.write(PAGE.format(title=html.escape(title)).encode())
                page.write(self._point(row).encode())
        finally:
            if page is not None:
                self._close(page)
        return Written(folder, names)

    @staticmethod
    def _close(page) -> None:
        page.write(DRAW.encode())
        page.close()

    def _point(self, row: Row) -> str:
        x = row["time"] if "time" in self.names and row["time"] is not None else row["x"]
        number = lambda v: v.timestamp() if isinstance(v, datetime) else v.total_seconds() if isinstance(v, timedelta) else float(v) if v is not None and math.isfinite(v) else None
        values = [row["plot_row"], row["title"], row["trace"], number(x), number(row["y"]), number(row["z"]) if "z" in self.names else None]
        return f"add({json.dumps(values)[1:-1].replace('<', '\\u003c')})\n"

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        for m in messages:
            for name in m.names if m else ():
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    @staticmethod
    def _clear(files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_temporary")


class Figures(DataSource):
    """A page for each series; options path and series (names of columns, by commas). Rows of a series come together."""

    @classmethod
    def name(cls) -> str:
        return "wavelark_figures"

    def writer(self, schema, overwrite: bool) -> FigureWriter:
        return FigureWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ringing)
    spark.dataSource.register(Figures)


def write_figures(traces: DataFrame, path: str, series_cols: Sequence[str] = ()) -> None:
    """A page for each series with the traces of a plot, written by the tasks that have them; one without ``series_cols``.

    ``path`` is a folder that all executors share. A page streams to its file, whatever its rows. A page of the same name is
    replaced; nothing appears where a task fails for good.
    """
    register(traces.sparkSession)
    rows = traces.repartition(*series_cols) if series_cols else traces.repartition(1)
    rows.sortWithinPartitions(*series_cols, "plot_row", "title", "trace").write.format("wavelark_figures").option("path", path).option("series", ",".join(series_cols)).mode("append").save()
