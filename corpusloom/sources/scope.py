"""Which files may be indexed: nothing but what lies under a declared root and passes every rule.

Directory listing, links and repository markers are matters of the driver's file system; contents are read by Spark,
and only of files that passed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from fnmatch import fnmatch
from pathlib import Path

from ..errors import ScopeError
from ..operators.ingest import ALWAYS_EXCLUDED, MAX_BYTES, SUFFIXES


def _list(value: object) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, Sequence):
        return [str(v) for v in value]
    raise ScopeError(f"expected a list, not {value!r}")


@dataclass(frozen=True)
class ScopeReport:
    per_root: tuple[tuple[Path, int], ...]
    total_bytes: int
    skipped: tuple[tuple[Path, str], ...] = ()

    @property
    def file_count(self) -> int:
        return sum(n for _, n in self.per_root)

    def render(self) -> str:
        rows = [f"  {n:>6}  {root}" for root, n in self.per_root] + [f"  {'--':>6}  {root}  ({why})" for root, why in self.skipped]
        total = f"  {self.file_count:>6}  files, {self.total_bytes / (1 << 20):.1f} MiB"
        return "\n".join(["Effective scope:", *rows, "  ------", total])


@dataclass(frozen=True)
class ScopePolicy:
    roots: tuple[Path, ...]
    suffixes: tuple[str, ...] = SUFFIXES
    exclude: tuple[str, ...] = ()
    follow_symlinks: bool = False
    skip_nested_repos: bool = True
    allow_repos: tuple[str, ...] = ()
    max_file_bytes: int = MAX_BYTES
    _patterns: tuple[str, ...] = field(init=False, repr=False, default=())

    def __post_init__(self) -> None:
        if not self.roots:
            raise ScopeError("no roots declared; nothing can be indexed")
        object.__setattr__(self, "_patterns", tuple(dict.fromkeys((*self.exclude, *ALWAYS_EXCLUDED))))

    @classmethod
    def from_config(cls, data: Mapping[str, object], base: Path | None = None) -> ScopePolicy:
        roots = [Path(r).expanduser() for r in _list(data.get("roots"))]
        return cls(
            roots=tuple(r if r.is_absolute() or base is None else (base / r).resolve() for r in roots),
            suffixes=tuple(s if s.startswith(".") else "." + s for s in _list(data.get("suffixes"))) or SUFFIXES,
            exclude=tuple(_list(data.get("exclude"))),
            follow_symlinks=bool(data.get("follow_symlinks", False)),
            skip_nested_repos=bool(data.get("skip_nested_repos", True)),
            allow_repos=tuple(_list(data.get("allow_repos"))),
            max_file_bytes=int(data.get("max_file_bytes", MAX_BYTES)),
        )

    @property
    def effective_exclude(self) -> tuple[str, ...]:
        return self._patterns

    def is_excluded(self, rel: str) -> bool:
        parts = rel.split("/")
        return any(fnmatch(rel, p) if "/" in p else any(fnmatch(part, p) for part in parts) for p in self._patterns)

    def _pruned(self, directory: str, rel: str) -> bool:
        if self.is_excluded(rel):
            return True
        if not self.skip_nested_repos or not os.path.exists(os.path.join(directory, ".git")):
            return False
        name = rel.rsplit("/", 1)[-1]
        return not any(fnmatch(rel if "/" in p else name, p) for p in self.allow_repos)

    def files(self, root: Path) -> Iterator[Path]:
        """Files of one root; excluded directories and nested repositories are not entered."""
        for here, directories, names in os.walk(root, followlinks=self.follow_symlinks):
            inside = os.path.relpath(here, root).replace(os.sep, "/")
            rel = lambda name, inside=inside: name if inside == "." else f"{inside}/{name}"
            directories[:] = sorted(d for d in directories if not self._pruned(os.path.join(here, d), rel(d)))
            for name in sorted(names):
                path = Path(here, name)
                if path.suffix.lower() not in self.suffixes or self.is_excluded(rel(name)):
                    continue
                if path.is_symlink() and not self.follow_symlinks:
                    continue
                try:
                    if path.stat().st_size <= self.max_file_bytes:
                        yield path
                except OSError:
                    continue

    def listing(self) -> list[tuple[Path, Path, str]]:
        """(file, deepest root that holds it, path for display and identity), each file once."""
        found: dict[Path, Path] = {}
        for root in sorted((r for r in self.roots if r.is_dir()), key=lambda r: len(r.parts)):
            for path in self.files(root):
                found[path] = root
        base = self.display_base()
        name = lambda path, root: path.relative_to(base).as_posix() if base and path.is_relative_to(base) else f"{root.name}/{path.relative_to(root).as_posix()}"
        return [(path, root, name(path, root)) for path, root in sorted(found.items())]

    def display_base(self) -> Path | None:
        """What paths are named against: the root, or the common parent of several, so that names stay unique."""
        if len(self.roots) == 1:
            return self.roots[0]
        try:
            return Path(os.path.commonpath([str(r) for r in self.roots]))
        except ValueError:
            return None

    def describe(self) -> ScopeReport:
        """Counts and sizes, from the listing alone."""
        counted, skipped, size = [], [], 0
        for root in self.roots:
            if not root.is_dir():
                skipped.append((root, "not a directory" if root.exists() else "does not exist"))
                continue
            files = list(replace(self, roots=(root,)).files(root))
            counted.append((root, len(files)))
            size += sum(f.stat().st_size for f in files)
        return ScopeReport(tuple(counted), size, tuple(skipped))
