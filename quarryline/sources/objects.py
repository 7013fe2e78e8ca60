"""Object stores for the ingest boundary: listing, streaming and hashing of files in one of three containers by
sensitivity. A folder stands in for a container; a store of another tenant is a second instance."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from pathlib import Path
from typing import IO

CHUNK = 8 << 20
CEILING = 16 << 20
SENSITIVITIES = ("public", "confidential", "phi")


class StreamTooLarge(ValueError):
    """A stream that was to be held in memory is larger than allowed."""


def drain(stream: IO[bytes], ceiling: int = CEILING) -> bytes:
    """All bytes of a stream that holds no more than a ceiling."""
    out = bytearray()
    while chunk := stream.read(min(CHUNK, ceiling + 1 - len(out))):
        out += chunk
        if len(out) > ceiling:
            raise StreamTooLarge(f"more than {ceiling} bytes")
    return bytes(out)


@dataclass(frozen=True)
class Stored:
    path: str
    size: int
    metadata: dict[str, str] = field(default_factory=dict)

    def meta(self, name: str) -> str | None:
        return next((v for k, v in self.metadata.items() if k.lower() == name.lower()), None)


class FolderStore:
    def __init__(self, containers: dict[str, str | Path]):
        if wrong := set(containers) - set(SENSITIVITIES):
            raise ValueError(f"unknown containers {sorted(wrong)}")
        self.containers = {k: Path(v) for k, v in containers.items()}

    def _root(self, sensitivity: str) -> Path:
        if sensitivity not in self.containers:
            raise ValueError(f"no container is set for {sensitivity!r}")
        return self.containers[sensitivity]

    def _at(self, sensitivity: str, path: str) -> Path:
        full = (self._root(sensitivity) / path).resolve()
        if not full.is_relative_to(self._root(sensitivity).resolve()):
            raise ValueError(f"{path!r} leaves its container")
        return full

    def list(self, sensitivity: str, prefix: str = "") -> Iterator[str]:
        root = self._root(sensitivity)
        for folder, dirs, names in os.walk(root):
            dirs.sort()
            for n in sorted(names):
                path = (Path(folder) / n).relative_to(root).as_posix()
                if path.startswith(prefix) and not n.endswith(".meta.json"):
                    yield path

    def child_prefixes(self, sensitivity: str, prefix: str = "") -> list[str]:
        return sorted({prefix + rest.split("/", 1)[0] + "/" for p in self.list(sensitivity, prefix) if "/" in (rest := p[len(prefix) :])})

    def exists(self, sensitivity: str, path: str) -> bool:
        return self._at(sensitivity, path).is_file()

    def head(self, sensitivity: str, path: str) -> Stored | None:
        at = self._at(sensitivity, path)
        if not at.is_file():
            return None
        side = at.with_name(at.name + ".meta.json")
        return Stored(path, at.stat().st_size, json.loads(side.read_text()) if side.exists() else {})

    def stream(self, sensitivity: str, path: str) -> IO[bytes]:
        return self._at(sensitivity, path).open("rb")

    def download(self, sensitivity: str, path: str, to: str | Path) -> Path:
        with self.stream(sensitivity, path) as src, Path(to).open("wb") as out:
            shutil.copyfileobj(src, out, CHUNK)
        return Path(to)

    def put(self, sensitivity: str, path: str, source: IO[bytes] | bytes | Path, metadata: dict[str, str] | None = None) -> tuple[str, int, bool]:
        """(sha256, size, written): hashed in the pass that copies; a file that is stored with the same hash stays."""
        at = self._at(sensitivity, path)
        at.parent.mkdir(parents=True, exist_ok=True)
        fresh, h, size = at.with_name(f".{at.name}.{uuid.uuid4().hex}"), hashlib.sha256(), 0
        stream = source.open("rb") if isinstance(source, Path) else source
        with fresh.open("wb") as out:
            if isinstance(stream, bytes):
                h.update(stream)
                size = out.write(stream)
            else:
                while chunk := stream.read(CHUNK):
                    h.update(chunk)
                    size += out.write(chunk)
        old = self.head(sensitivity, path)
        if old and old.meta("sha256") == h.hexdigest():
            fresh.unlink()
            return h.hexdigest(), size, False
        os.replace(fresh, at)
        at.with_name(at.name + ".meta.json").write_text(json.dumps({"sha256": h.hexdigest(), **(metadata or {})}, sort_keys=True))
        return h.hexdigest(), size, True


def resolve_glob(paths: Iterator[str], pattern: str, match: str = "one", exclude: tuple[str, ...] = ()) -> list[str]:
    """Paths that fit a pattern (* crosses /), without the manifest: exactly one, or one at least, sorted."""
    found = sorted(p for p in paths if fnmatch(p, pattern) and not p.endswith("_manifest.json") and not any(fnmatch(p, e) for e in exclude))
    if match == "one" and len(found) != 1 or not found:
        raise LookupError(f"{pattern!r} fits {len(found)} files; {'one' if match == 'one' else 'one at least'} is needed: {found[:5]}")
    return found
