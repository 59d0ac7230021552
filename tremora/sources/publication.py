"""Publication: typed canonical documents, Arrow files, bundles under a lock, fixed files and the registry.

These are small documents and finished artifacts on a file system that the driver reaches; tables stay with Spark.
"""

from __future__ import annotations

import contextlib
import dataclasses
import datetime as dt
import hashlib
import json
import math
import os
import tempfile
import unicodedata
from collections.abc import Iterator, Mapping
from pathlib import Path, PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tremora.sources.sinks import canonical_json, write_atomic

#: Key of an object that stands for a number with all its bits.
TYPED = "$tremora_type"
#: Rows of each batch of an Arrow file.
BATCH = 65_536
#: Where each kind of bundle lies, below the project.
ROOTS = {"processed": "data/processed", "model": "models", "backtest": "backtests", "experiment": "experiments"}
#: Words that a report may not use of an intensity.
FORBIDDEN = ("probability", "probabilities")


def plain(value, where: str = "$"):
    """Results as JSON values, without loss: numbers of NumPy, dates, arrays, data classes and mappings with text keys.
    Anything else, non-finite numbers too, raises with its place."""
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, np.generic):
        return plain(value.item(), where)
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{where} is not finite")
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            raise ValueError(f"{where} has no time zone")
        return value.astimezone(dt.UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, np.ndarray):
        return plain(value.tolist(), where)
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name), f"{where}.{f.name}") for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        if any(not isinstance(k, str) for k in value):
            raise TypeError(f"{where} has a key that is no text")
        return {k: plain(value[k], f"{where}.{k}") for k in sorted(value)}
    if isinstance(value, list | tuple):
        return [plain(x, f"{where}[{i}]") for i, x in enumerate(value)]
    raise TypeError(f"{where} is a {type(value).__name__}, which has no JSON form")


def plain_mapping(value) -> dict:
    out = plain(value)
    if not isinstance(out, dict):
        raise TypeError("a document is a mapping")
    return out


def typed(value, where: str = "$"):
    """A value for an exact address: text in NFC, floats by their hexadecimal digits. Raises for the reserved key, keys
    that become equal, non-finite numbers and paths."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if value is None or isinstance(value, bool | int):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{where} is not finite")
        return {TYPED: "float", "hex": value.hex()}
    if isinstance(value, Mapping):
        if TYPED in value:
            raise ValueError(f"{where} uses the reserved key")
        out = {}
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError(f"{where} has a key that is no text")
            name = unicodedata.normalize("NFC", k)
            if name in out:
                raise ValueError(f"{where}: two keys become {name}")
            out[name] = typed(v, f"{where}.{name}")
        return out
    if isinstance(value, list | tuple):
        return [typed(x, f"{where}[{i}]") for i, x in enumerate(value)]
    raise TypeError(f"{where}: {'paths have no place in an address' if isinstance(value, PurePath) else type(value).__name__}")


def typed_json(value) -> bytes:
    return json.dumps(typed(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def arrow_batches(df: DataFrame, schema: pa.Schema, rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of df under an explicit schema, in batches: they come one after another and are never all in memory."""
    held: list = []
    for row in df.select(*schema.names).toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict())
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def write_arrow(df: DataFrame, schema: pa.Schema, path: str | os.PathLike, rows: int = BATCH) -> str:
    """An Arrow IPC file; returns its SHA-256."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, schema) as out:
        for batch in arrow_batches(df, schema, rows):
            out.write_batch(batch)
    return digest(path)


def digest(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@contextlib.contextmanager
def locked(home: Path) -> Iterator[None]:
    """Only one process at a time publishes under this name; a second one raises."""
    mark = home.with_name(f".{home.name}.lock")
    home.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(mark, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as held:
        raise RuntimeError(f"{home} is being published by another process") from held
    try:
        os.close(handle)
        yield
    finally:
        mark.unlink(missing_ok=True)


def relative(name: str) -> PurePath:
    path = PurePath(name)
    if path.is_absolute() or ".." in path.parts or "\\" in name or not path.parts:
        raise ValueError(f"{name!r} is no relative path of the project")
    return path


def publish(project: str | os.PathLike, kind: str, inputs, files: dict[str, bytes]) -> Path:
    """A bundle of one of the four kinds, in a directory named by its typed inputs, with a manifest. An equal one that
    exists is verified and kept; a different one raises. Nothing half written is ever seen, or left behind."""
    if kind not in ROOTS:
        raise ValueError(f"{kind} is no kind of bundle")
    if not files:
        raise ValueError("a bundle holds files")
    address = typed_json({"kind": kind, "inputs": inputs})
    home = Path(project) / ROOTS[kind] / hashlib.sha256(address).hexdigest()[:32]
    manifest = canonical_json({"kind": kind, "address": address.decode(), "files": {str(relative(n)): {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in files.items()}})
    with locked(home):
        if home.exists():
            faults = verify(home)
            if faults or (home / "manifest.json").read_bytes() != manifest:
                raise FileExistsError(f"{home} holds something else: {faults}")
            return home
        with tempfile.TemporaryDirectory(dir=home.parent, prefix=".work-") as work:
            ready = Path(work) / "bundle"
            for name, payload in {**files, "manifest.json": manifest}.items():
                write_atomic(ready / name, payload)
            os.replace(ready, home)
    return home


def verify(home: str | os.PathLike) -> list[str]:
    """What is wrong with a bundle on disk: files that are missing, more or changed."""
    home = Path(home)
    recorded = json.loads((home / "manifest.json").read_bytes())["files"]
    there = {str(p.relative_to(home)) for p in home.rglob("*") if p.is_file()} - {"manifest.json"}
    faults = [f"missing {n}" for n in sorted(set(recorded) - there)] + [f"unknown {n}" for n in sorted(there - set(recorded))]
    return faults + [f"changed {n}" for n in sorted(set(recorded) & there) if digest(home / n) != recorded[n]["sha256"]]


def publish_fixed(project: str | os.PathLike, name: str, payload: bytes) -> bool:
    """Creates a file under a fixed name, whole, or verifies that its bytes are there. Whether it was created."""
    if not payload:
        raise ValueError("a fixed file is not empty")
    target = Path(project) / relative(name)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=".fixed-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, target)  # fails where the name exists: nothing is ever written over
            return True
        except FileExistsError as known:
            if target.read_bytes() != payload:
                raise FileExistsError(f"{target} holds other bytes") from known
            return False
    finally:
        os.unlink(temporary)


def registry(entries: list[dict], models: tuple[str, ...], snapshots: tuple[str, ...]) -> dict:
    """The registry's payload: entries (model, snapshot, status scored or failed, reasons, gain, artifact) in order,
    with their digest. Raises where registry_faults finds any."""
    ordered = sorted((plain_mapping(e) for e in entries), key=lambda e: (models.index(e["model"]) if e["model"] in models else len(models), e["snapshot"]))
    if faults := registry_faults(ordered, models, snapshots):
        raise ValueError("; ".join(faults))
    return {"models": list(models), "snapshots": list(snapshots), "entries": ordered, "sha256": hashlib.sha256(typed_json(ordered)).hexdigest()}


def registry_faults(entries: list[dict], models: tuple[str, ...], snapshots: tuple[str, ...]) -> list[str]:
    """Of every model each snapshot must be scored or failed, once; a failure has reasons, a score a finite gain."""
    out = [f"unknown model {e['model']}" for e in entries if e["model"] not in models] + [f"unknown snapshot {e['snapshot']}" for e in entries if e["snapshot"] not in snapshots]
    for m in models:
        mine = [e for e in entries if e["model"] == m]
        scored, failed = ({e["snapshot"] for e in mine if e["status"] == s} for s in ("scored", "failed"))
        if scored & failed or len(mine) != len(scored | failed):
            out.append(f"{m}: a snapshot comes twice")
        if scored | failed != set(snapshots):
            out.append(f"{m}: snapshots {sorted(set(snapshots) - scored - failed)} are not accounted for")
        out += [f"{m}/{e['snapshot']}: a failure without reasons" for e in mine if e["status"] == "failed" and not e.get("reasons")]
        out += [f"{m}/{e['snapshot']}: a score without gain" for e in mine if e["status"] == "scored" and not isinstance(e.get("gain"), float)]
    return out


def report(payload: dict) -> bytes:
    """Markdown of a registry, the same for the same payload. Intensities are no chances: it refuses to say so."""
    lines = ["# Background models", "", f"Registry `{payload['sha256']}`", "", "| model | snapshot | status | gain | reasons |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {e['model']} | {e['snapshot']} | {e['status']} | {'' if e.get('gain') is None else format(e['gain'], '.6f')} | {', '.join(e.get('reasons') or ())} |" for e in payload["entries"]]
    text = "\n".join([*lines, ""])
    if any(w in text.lower() for w in FORBIDDEN):
        raise ValueError("a report does not speak of probabilities")
    return text.encode()


def publish_registry(project: str | os.PathLike, payload: dict, registry_name: str, report_name: str) -> None:
    """Registry and report, both or none: a registry that this call created goes again where the report fails."""
    made = publish_fixed(project, registry_name, canonical_json(payload))
    try:
        publish_fixed(project, report_name, report(payload))
    except BaseException:
        if made:
            (Path(project) / relative(registry_name)).unlink()
        raise
