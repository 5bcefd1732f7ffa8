"""Recordings as blocks of samples, read by byte range.

Headers are scanned first (two short reads per file). Each file then becomes as many rows as it
has blocks of whole data records, so a long file is read by many tasks. A block carries a halo
of neighbouring samples on both sides; no later step needs another block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from windrow.fixed_values import ELECTRODES
from windrow.sources.headers import FIXED_BYTES, FIXED_FIELDS, SIGNAL_BYTES, SIGNAL_FIELDS

FILES_PER_TASK = 64
BLOCKS_PER_TASK = 8
HEADER_SCHEMA = (
    "record_id string, path string, fs double, n_samples long, n_blocks int, "
    "channels array<string>, missing array<string>, error string"
)
BLOCK_SCHEMA = (
    "record_id string, path string, block_idx int, fs double, n_samples long, block_start long, "
    "block_len long, halo_left int, channels array<string>, samples array<array<double>>, "
    "missing array<string>, error string"
)
HEADER_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("path", pa.string()), ("fs", pa.float64()),
        ("n_samples", pa.int64()), ("n_blocks", pa.int32()), ("channels", pa.list_(pa.string())),
        ("missing", pa.list_(pa.string())), ("error", pa.string()),
    ]
)
ARROW_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("path", pa.string()), ("block_idx", pa.int32()),
        ("fs", pa.float64()), ("n_samples", pa.int64()), ("block_start", pa.int64()),
        ("block_len", pa.int64()), ("halo_left", pa.int32()), ("channels", pa.list_(pa.string())),
        ("samples", pa.list_(pa.list_(pa.float64()))), ("missing", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)
# Volts per unit.
UNIT_VOLTS = {"uV": 1e-6, "µV": 1e-6, "mV": 1e-3, "V": 1.0}


@dataclass(frozen=True)
class BlockPlan:
    """How recordings are cut and which channels are taken."""

    canonical: tuple[str, ...] = ()
    on_missing: str = "skip_file"
    block_sec: float = 600.0
    halo_sec: float = 40.0


def read_header(read: Callable[[int, int], bytes]) -> dict:
    """Header fields from ``read(offset, length)``: the fixed part, then the signal part."""
    fixed = read(0, FIXED_BYTES)
    if len(fixed) < FIXED_BYTES:
        raise ValueError(f"{len(fixed)} bytes are fewer than the fixed part of a header")
    head = {
        name: fixed[start - 1 : start - 1 + width].decode("ascii", "replace").strip()
        for name, start, width in FIXED_FIELDS
    }
    ns = int(head["n_signals"])
    if ns < 1:
        raise ValueError(f"no signals declared: {ns}")
    rest = read(FIXED_BYTES, SIGNAL_BYTES * ns)
    need = FIXED_BYTES + SIGNAL_BYTES * ns
    if len(rest) < SIGNAL_BYTES * ns:
        raise ValueError(f"header cut at byte {FIXED_BYTES + len(rest)} of {need}")
    if int(head["declared_bytes"]) != need:
        raise ValueError(f"header says it has {head['declared_bytes']} bytes but has {need}")
    at = 0
    for name, width in SIGNAL_FIELDS:
        cells = [rest[at + i * width : at + (i + 1) * width] for i in range(ns)]
        head[name] = [c.decode("ascii", "replace").strip() for c in cells]
        at += width * ns
    for name in ("phys_min", "phys_max", "dig_min", "dig_max"):
        head[name] = np.array(head[name], dtype=float)
    head["samples_per_record"] = np.array(head["samples_per_record"], dtype=int)
    head["record_sec"] = float(head["record_duration_sec"])
    if not 0 < head["record_sec"] < float("inf"):
        raise ValueError(f"no usable length of a data record: {head['record_duration_sec']}")
    head["n_records"] = int(head["n_records"])
    head["header_bytes"] = need
    return head


def choose_signals(labels: list[str], plan: BlockPlan) -> tuple[dict[str, int], list[str]]:
    """First position of each wanted label, in canonical order, and the labels not there."""
    first: dict[str, int] = {}
    for i, raw in enumerate(labels):
        label = "".join(raw.split()).upper()
        a, _, b = label.partition("-")
        if a != b and a in ELECTRODES and b in ELECTRODES:
            first.setdefault(label, i)
    wanted = list(plan.canonical) or list(first)
    return {c: first[c] for c in wanted if c in first}, [c for c in wanted if c not in first]


def signal_facts(head: dict, plan: BlockPlan) -> dict:
    """Rate, length, blocks and channels of a recording, or why it is refused."""
    chosen, missing = choose_signals(head["labels"], plan)
    sizes = {int(head["samples_per_record"][i]) for i in chosen.values()}
    per_block = max(1, int(plan.block_sec // head["record_sec"]))
    refused = None
    if missing and plan.on_missing == "skip_file":
        refused = "missing_channels:" + ",".join(missing)
    elif not chosen:
        refused = "no_usable_channels"
    elif len(sizes) > 1:
        refused = "unexpected_sample_rate:-1.0"
    fill = plan.canonical and plan.on_missing == "fill_nan"
    return {
        "fs": max(sizes, default=0) / head["record_sec"],
        "n_samples": head["n_records"] * max(sizes, default=0),
        "n_blocks": -(-head["n_records"] // per_block),
        "channels": list(plan.canonical) if fill else list(chosen),
        "missing": missing,
        "error": refused,
        "chosen": chosen,
        "per_block": per_block,
    }


def record_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def header_row(read: Callable[[int, int], bytes], path: str, plan: BlockPlan) -> dict:
    """One header row; a file that cannot be read becomes a row with its error."""
    row = dict.fromkeys(("fs", "n_samples", "n_blocks", "channels", "missing", "error"))
    try:
        head = read_header(read)
        facts = signal_facts(head, plan)
        row.update({k: facts[k] for k in row})
        signal_bytes = head["n_records"] * int(head["samples_per_record"].sum()) * 2
        if signal_bytes < 0:
            raise ValueError("unknown number of data records")
        if signal_bytes and not read(head["header_bytes"] + signal_bytes - 1, 1):
            raise ValueError(f"samples end before byte {signal_bytes}")
    except (ValueError, ArithmeticError, OSError) as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return {"record_id": record_name(path), "path": path, **row}


def read_block(read: Callable[[int, int], bytes], path: str, plan: BlockPlan, b: int) -> dict:
    """One block in volts, ``samples`` as an array (channels, samples with halos)."""
    head = read_header(read)
    facts = signal_facts(head, plan)
    if facts["error"]:
        raise ValueError(facts["error"])
    per_record = head["samples_per_record"]
    size = int(facts["n_samples"] // head["n_records"])
    stride = int(per_record.sum())
    starts = np.concatenate([[0], np.cumsum(per_record)])
    halo = int(np.ceil(plan.halo_sec / head["record_sec"]))
    lo = b * facts["per_block"]
    hi = min(head["n_records"], lo + facts["per_block"])
    first, last = max(0, lo - halo), min(head["n_records"], hi + halo)
    want = (last - first) * stride * 2
    raw = read(head["header_bytes"] + first * stride * 2, want)
    if len(raw) < want:
        raise ValueError(f"block {b} has {len(raw)} of {want} bytes")
    table = np.frombuffer(raw, "<i2").reshape(last - first, stride)
    samples = np.full((len(facts["channels"]), (last - first) * size), np.nan)
    for row, label in enumerate(facts["channels"]):
        i = facts["chosen"].get(label)
        if i is None:
            continue
        x = table[:, starts[i] : starts[i + 1]].ravel().astype(np.float64)
        gain = (head["phys_max"][i] - head["phys_min"][i]) / (head["dig_max"][i] - head["dig_min"][i])
        volts = UNIT_VOLTS.get(head["units"][i], 1.0)
        samples[row] = ((x - head["dig_min"][i]) * gain + head["phys_min"][i]) * volts
    return {
        "record_id": record_name(path), "path": path, "block_idx": b, "fs": facts["fs"],
        "n_samples": facts["n_samples"], "block_start": lo * size, "block_len": (hi - lo) * size,
        "halo_left": (lo - first) * size, "channels": facts["channels"], "samples": samples,
        "error": None,
    }


def nested(values: np.ndarray) -> pa.Array:
    """A 3-d array as list<list<value>>, one outer list per first index."""
    n, rows, width = values.shape
    inner = pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * rows * width + 1, width, dtype=np.int32)), pa.array(values.ravel())
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * rows + 1, rows, dtype=np.int32)), inner)


def block_batch(block: dict) -> pa.RecordBatch:
    samples = block.get("samples")
    columns = []
    for field in ARROW_SCHEMA:
        if field.name == "samples" and samples is not None:
            columns.append(nested(samples[None]))
        else:
            columns.append(pa.array([block.get(field.name)], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


def block_dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """Block rows of a batch with ``samples`` as an array, without Python floats."""
    names = [n for n in batch.schema.names if n != "samples"]
    samples = batch.column("samples")
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in names}
        inner = samples[i].values
        flat = inner.flatten().to_numpy(zero_copy_only=False)
        yield {**row, "samples": flat.reshape(len(inner), -1)}


def failed_block(path: str, b: int, e: Exception) -> dict:
    return {"record_id": record_name(path), "path": path, "block_idx": b, "error": f"{type(e).__name__}: {e}"}


def opened(path: str) -> Callable[[int, int], bytes]:
    """``read(offset, length)`` of a file on any file system Arrow knows."""
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(_uri(path))
    handle = filesystem.open_input_file(inner)

    def read(at: int, n: int) -> bytes:
        return handle.read_at(n, at)

    return read


def _uri(path: str) -> str:
    return path if ":/" in path else "file://" + path


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.plan = BlockPlan(**json.loads(options["plan"]))

    def partitions(self):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(_uri(self.root))
        scheme = self.root.split(":/")[0] + "://" if ":/" in self.root else ""
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(scheme + f.path for f in found if f.is_file and f.path.endswith(".edf"))
        return [FileGroup(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)]

    def read(self, partition):
        for path in partition.value:
            try:
                row = header_row(opened(path), path, self.plan)
            except OSError as e:
                row = {"record_id": record_name(path), "path": path, "error": f"{type(e).__name__}: {e}"}
            yield tuple(row.get(c.split()[0]) for c in HEADER_SCHEMA.split(", "))


class HeaderSource(DataSource):
    """Header rows of the recordings under a folder, from two short reads per file."""

    @classmethod
    def name(cls):
        return "recording_headers"

    def schema(self):
        return HEADER_SCHEMA

    def reader(self, schema):
        return HeaderReader(self.options)


def recording_headers(spark: SparkSession, root: str, plan: BlockPlan) -> DataFrame:
    spark.dataSource.register(HeaderSource)
    options = json.dumps({**plan.__dict__, "canonical": list(plan.canonical)})
    return spark.read.format("recording_headers").option("plan", options).load(root)


def block_list(headers: DataFrame) -> DataFrame:
    """One row per block of the readable recordings, spread over tasks of a few blocks each.

    A row is tiny but stands for megabytes to read, so the number of tasks follows the number of
    blocks and is given outright; adaptive execution would pack the rows by their own size.
    """
    readable = headers.where("error IS NULL AND n_blocks > 0")
    total = readable.agg(F.sum("n_blocks")).head()[0] or 0
    tasks = max(1, -(-total // BLOCKS_PER_TASK))
    return readable.select(
        "path", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block_idx")
    ).repartition(tasks, "path", "block_idx")


def blocks_of_files(batch: pa.RecordBatch, plan: BlockPlan) -> Iterator[dict]:
    """The blocks named by (path, block_idx) rows; one that cannot be read carries its error."""
    for path, b in zip(batch.column("path").to_pylist(), batch.column("block_idx").to_pylist()):
        try:
            yield read_block(opened(path), path, plan, b)
        except (ValueError, ArithmeticError, OSError) as e:
            yield failed_block(path, b, e)


def blocks_of_contents(batch: pa.RecordBatch, plan: BlockPlan) -> Iterator[dict]:
    """The blocks of recordings loaded whole as ``path, content``."""
    for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
        data = memoryview(content.as_buffer())

        def read(at: int, n: int, data=data) -> bytes:
            return bytes(data[at : at + n])

        head = header_row(read, path, plan)
        if head["error"]:
            yield {**failed_block(path, 0, ValueError("")), **head, "block_idx": 0}
            continue
        for b in range(head["n_blocks"]):
            try:
                yield read_block(read, path, plan, b)
            except (ValueError, ArithmeticError, OSError) as e:
                yield failed_block(path, b, e)


def read_recordings(headers: DataFrame, plan: BlockPlan) -> DataFrame:
    """Sample blocks of the recordings in a header table."""

    def run(batches):
        for batch in batches:
            for block in blocks_of_files(batch, plan):
                yield block_batch(block)

    return block_list(headers).mapInArrow(run, BLOCK_SCHEMA)


def decode_contents(files: DataFrame, plan: BlockPlan) -> DataFrame:
    """Sample blocks of recordings already loaded as ``path, content`` (batch or streaming)."""

    def run(batches):
        for batch in batches:
            for block in blocks_of_contents(batch, plan):
                yield block_batch(block)

    return files.select("path", "content").mapInArrow(run, BLOCK_SCHEMA)
