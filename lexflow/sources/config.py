"""Settings of a build: where its sources are and where its results go."""

import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    docx: str = ""
    xlsx: str = ""
    references: str = ""
    information: str = ""
    private_dir: str = ""
    export_dir: str = ""


#: Names of the settings in a file's tables. Fixed values.
KEYS = {"docx": ("sources", "docx"), "xlsx": ("sources", "xlsx"), "references": ("sources", "referencias"), "information": ("sources", "informacoes"), "private_dir": ("output", "private"), "export_dir": ("output", "chatbot")}


def load(path: str, lenient: bool = False) -> Config:
    """The settings in a TOML file; those it lacks are ''. A missing file gives none, lenient a broken one too."""
    if not Path(path).exists():
        return Config()
    try:
        with open(path, "rb") as f:
            own = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        if lenient:
            return Config()
        raise
    return Config(**{k: str(own.get(table, {}).get(name, "")) for k, (table, name) in KEYS.items()})
