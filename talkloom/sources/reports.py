"""Driver-side files: reports, atomic documents, prompts in doubtful encodings, failure artefacts."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A result of a report's size as a Markdown table; more rows than ``most`` are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows is a table: write it with Spark")
    show = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def replace_document(path: str | Path, document: dict) -> None:
    """One JSON document replaced as a whole: a reader sees the old or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def read_text(path: str | Path) -> str:
    """Text in the first encoding that fits: UTF-8 (a mark allowed), UTF-16, Windows-1252."""
    data = Path(path).read_bytes()
    order = ("utf-16", "utf-8-sig") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252")
    for name in order:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace")


def resolve_run(path: str | Path) -> Path:
    """A run document itself, or the judged one, else the summary, of a run folder."""
    path = Path(path)
    if not path.is_dir():
        return path
    for name in ("judged.json", "summary.json"):
        if (path / name).exists():
            return path / name
    raise FileNotFoundError(f"no judged.json or summary.json in {path}")


def write_failures(df: DataFrame, path: str) -> None:
    """One folder per scenario and criterion, for looking at failures one by one."""
    df.where("verdict <> 'PASS'").write.mode("overwrite").partitionBy("scenario_id", "criterion_id").json(path)
