"""Settings of libraries and devices as JSON, with defaults for what a file lacks."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class LibrarySettings:
    directory_format: str = "{Author}"
    hidden_columns: list[str] = field(default_factory=list)


@dataclass
class DeviceSettings:
    directory_format: str = "{Author}"
    title_format: str = "[{Series}] {Title}"
    change_title_on_sync: bool = False


def read(path: str, kind: type):
    """The settings in a file, which is made with the defaults if it isn't there. Unknown keys are ignored."""
    if not os.path.exists(path):
        return write(path, kind())
    with open(path) as f:
        given = json.load(f)
    return kind(**{x.name: given[x.name] for x in fields(kind) if x.name in given})


def write(path: str, settings):
    temporary = f"{path}.{os.getpid()}"
    with open(temporary, "w") as f:
        json.dump(asdict(settings), f)
    os.replace(temporary, path)
    return settings


def save_hidden_columns(path: str, settings: LibrarySettings, hidden: list[str]) -> bool:
    """Writes only if the columns or their order differ; whether it did."""
    if settings.hidden_columns == hidden:
        return False
    settings.hidden_columns = list(hidden)
    write(path, settings)
    return True


def needs_reorganizing(old: DeviceSettings, new: DeviceSettings) -> bool:
    return old.directory_format != new.directory_format


def from_column(text: Column) -> Column:
    """Device settings in a JSON column."""
    return F.from_json(text, "directory_format string, title_format string, change_title_on_sync boolean")
