"""Settings from an INI file, as one frozen value on the driver."""

from __future__ import annotations

from configparser import ConfigParser
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    host: str | None = None
    port: int | None = None
    username: str | None = None
    password: str | None = None
    timeout: int = 60
    max_workers: int = 5
    groups: tuple[str, ...] = ()
    base_path: str | None = None
    subject_like: str | None = None
    from_like: str | None = None
    not_subject: str | None = None
    not_from: str | None = None
    local_min: int | None = None
    local_max: int | None = None
    min_days: float | None = None
    max_days: float | None = None
    output_path: str | None = None
    require_complete_sets: bool = False
    group_by_collection: bool = False


def load(path: str) -> Settings:
    """Settings of the file at ``path``; a missing file gives the defaults.  Group names are stripped."""
    c = ConfigParser(interpolation=None)
    c.read(path)
    text = lambda s, k: c.get(s, k, fallback="").strip() or None
    number = lambda s, k, kind: kind(v) if (v := text(s, k)) is not None else None
    return Settings(
        host=text("servers", "host"), port=number("servers", "port", int), username=text("servers", "username"), password=text("servers", "password"),
        timeout=number("servers", "timeout", int) or 60, max_workers=number("servers", "max_workers", int) or 5,
        groups=tuple(g.strip() for g in (text("groups", "names") or "").split(",") if g.strip()),
        base_path=text("db", "DB_BASE_PATH"),
        subject_like=text("filters", "subject_like"), from_like=text("filters", "from_like"), not_subject=text("filters", "not_subject"), not_from=text("filters", "not_from"),
        local_min=number("filters", "local_min", int), local_max=number("filters", "local_max", int),
        min_days=number("filters", "min_days", float), max_days=number("filters", "max_days", float),
        output_path=text("nzb", "output_path"),
        require_complete_sets=c.getboolean("nzb", "require_complete_sets", fallback=False), group_by_collection=c.getboolean("nzb", "group_by_collection", fallback=False),
    )
