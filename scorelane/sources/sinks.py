"""Sinks of small results on the driver, and of candidates with a receipt."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from scorelane.sources.readers import canonical_lines


def pretty(value: object, sort: bool = False) -> str:
    """JSON of two columns' indent; numbers that aren't finite are an error."""
    return json.dumps(value, indent=2, ensure_ascii=False, sort_keys=sort, allow_nan=False)


def apart(output: str, inputs: Iterable[str]) -> None:
    """Raise ValueError if the output is one of the inputs, by whatever name."""
    out = Path(output)
    for name in map(Path, inputs):
        if out.resolve() == name.resolve() or (out.exists() and name.exists() and os.path.samefile(out, name)):
            raise ValueError("the output must not replace an input")


def write_report(output: str, text: str, inputs: Iterable[str] = ()) -> None:
    """Write a text under a temporary name and rename it, so that readers see all of it or what was there before."""
    apart(output, inputs)
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{path.name}.", suffix=".tmp", dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_frozen(output: str, payload: bytes) -> bool:
    """Create a file that may never change: True if it was made, False if it is there with these bytes, else ValueError."""
    path = Path(output)
    if path.is_symlink():
        raise ValueError(f"{output}: a link")
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=".frozen-", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(name, path)
            return True
        except FileExistsError:
            if path.is_symlink() or path.read_bytes() != payload:
                raise ValueError(f"{output}: another file is there") from None
            return False
    finally:
        Path(name).unlink(missing_ok=True)


def export(folder: str, tables: dict[str, tuple[DataFrame, list[str]]], documents: dict[str, object]) -> dict[str, dict]:
    """Write tables (a frame and its order) as canonical JSON lines and documents as JSON into a new folder.

    Returns the receipt, written as receipt.json: of each file its SHA-256 and bytes, of a table its
    rows. Everything is made beside the folder and moved there at the end; if anything fails, nothing
    is left. Tables are streamed through the driver, row by row.
    """
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    made = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    receipt: dict[str, dict] = {}
    try:
        made.mkdir()
        for name, (rows, order) in tables.items():
            digest, size, n = hashlib.sha256(), 0, 0
            with (made / f"{name}.jsonl").open("xb") as f:
                for row in rows.orderBy(*order).select(canonical_lines(rows).alias("value")).toLocalIterator():
                    line = (row["value"] + "\n").encode()
                    f.write(line)
                    digest.update(line)
                    size, n = size + len(line), n + 1
            receipt[f"{name}.jsonl"] = {"bytes": size, "rows": n, "sha256": digest.hexdigest()}
        for name, value in documents.items():
            raw = (pretty(value, sort=True) + "\n").encode()
            (made / f"{name}.json").write_bytes(raw)
            receipt[f"{name}.json"] = {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
        (made / "receipt.json").write_text(pretty(receipt, sort=True) + "\n", encoding="utf-8")
        os.rename(made, target)
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise
    return receipt


def verify(folder: str) -> list[str]:
    """Names of the files of an export that are missing, were added or don't have the receipt's bytes."""
    path = Path(folder)
    receipt = json.loads((path / "receipt.json").read_text(encoding="utf-8"))
    there = {p.name for p in path.iterdir()} - {"receipt.json"}
    changed = [n for n, told in receipt.items() if n in there and hashlib.sha256((path / n).read_bytes()).hexdigest() != told["sha256"]]
    return sorted((there ^ receipt.keys()) | set(changed))
