"""Settings from the environment and a .env file; secrets never show."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields

PREFIX = "CHRONOSIFT_"


class Secret:
    """A value that prints as stars."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret('**********')" if self._value else "Secret('')"

    __str__ = __repr__


@dataclass(frozen=True)
class Settings:
    source_root: str = ""
    store_root: str = "data"
    index_pattern: str = "*"
    page_size: int = 5000
    training_end: str = "2025-08-01T00:00:00Z"
    log_level: str = "INFO"
    password: Secret = field(default_factory=lambda: Secret(""))

    def __post_init__(self) -> None:
        if self.page_size < 1:
            raise ValueError("page_size must be positive")
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR"):
            raise ValueError(f"unknown log level {self.log_level}")


def read_env_file(path: str) -> dict[str, str]:
    """KEY=value lines; comments and blank lines don't count, quotes around a value are dropped."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
                    out[m[1]] = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] in "\"'" else m[2]
    return out


def load(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    """The environment goes before the file, the file before the defaults."""
    known = read_env_file(env_file) | dict(os.environ if environ is None else environ)
    kinds = {"int": int, "Secret": Secret}
    got = {f.name: kinds.get(str(f.type), str)(known[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in known}
    return Settings(**got)


def scrub(text: str, settings: Settings) -> str:
    """Text without the secrets' values, and without passwords in addresses."""
    if settings.password.reveal():
        text = text.replace(settings.password.reveal(), "**********")
    return re.sub(r"(://[^/\s:@]+:)[^/\s@]+@", r"\1**********@", text)
