"""Writers: JSON, cleaned tables with their audit log, archives."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
import zipfile
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path


def plain(value):
    """Builtin types only; NaN and infinities become None, and what is unknown its text."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, (float, Decimal)):
        return float(value) if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return str(value)


def write_json(path: str | Path, payload) -> None:
    """Write next to the target, then rename: readers see the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    staged.write_text(json.dumps(plain(payload), indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(staged, path)


def publish_together(files: dict[str, Callable[[str], None]]) -> None:
    """Write all files beside their targets, then put them in place; if one step fails, the old files are back."""
    token, staged, kept, placed = uuid.uuid4().hex, {}, {}, []
    try:
        for target, write in files.items():
            os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
            staged[target] = f"{target}.{token}.new"
            write(staged[target])
        for target in files:
            if os.path.exists(target):
                kept[target] = f"{target}.{token}.old"
                shutil.copy2(target, kept[target])
        for target in files:
            os.replace(staged[target], target)
            placed.append(target)
    except BaseException:
        for target in placed:
            if target in kept:
                os.replace(kept[target], target)
            else:
                os.unlink(target)
        raise
    finally:
        for path in [*staged.values(), *kept.values()]:
            if os.path.exists(path):
                os.unlink(path)


def extract_zip(archive: str, target: str, max_files: int = 20_000, max_bytes: int = 200 << 20) -> str:
    """Unpack an archive whose members all stay inside the target; returns the single top folder, if there is one."""
    root = os.path.realpath(target)
    with zipfile.ZipFile(archive) as z:
        members = z.infolist()
        if len(members) > max_files or sum(m.file_size for m in members) > max_bytes:
            raise ValueError("the archive is too large")
        for m in members:
            name = m.filename.replace("\\", "/")
            inside = os.path.realpath(os.path.join(root, name))
            if name.startswith("/") or ".." in name.split("/") or os.path.commonpath([root, inside]) != root:
                raise ValueError(f"unsafe member {m.filename!r}")
        z.extractall(root)
    top = [n for n in os.listdir(root) if not n.startswith((".", "__"))]
    return os.path.join(root, top[0]) if len(top) == 1 and os.path.isdir(os.path.join(root, top[0])) else root
