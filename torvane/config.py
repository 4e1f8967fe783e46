"""Settings of the engine: fixed-point format, truncation mode and seed, from code, text, a file, the environment or a command line."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """f fraction bits and i integer bits. Comparisons look at bit f + i + 1, which must be below the sign bit's place or on it."""

    f: int = 10
    i: int = 15
    truncation: str = "exact"
    seed: int = 1

    def __post_init__(self) -> None:
        if self.f < 1 or self.i < 1 or self.f + self.i > 62:
            raise ValueError(f"f and i must be positive, with a sum of 62 at most: {self.f}, {self.i}")
        if self.truncation not in ("exact", "local"):
            raise ValueError(f"truncation is exact or local: {self.truncation}")

    @property
    def one(self) -> int:
        return 1 << self.f

    @property
    def compare_bit(self) -> int:
        return self.f + self.i + 1

    @classmethod
    def parse(cls, **settings: str) -> EngineConfig:
        """From text settings, as of a command line or the environment; unknown names are errors."""
        kinds = {"f": int, "i": int, "truncation": str, "seed": int}
        if unknown := settings.keys() - kinds.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](v) for k, v in settings.items()})

    @classmethod
    def load(cls, path: str, environment: Mapping[str, str] | None = None, prefix: str = "APP") -> EngineConfig:
        """From the table [engine] of a TOML file that must exist; a variable like APP_F or APP_SEED goes before the file's value."""
        file = Path(path)
        if not file.is_file():
            raise ValueError(f"no such file: {path}")
        try:
            settings = tomllib.loads(file.read_text()).get("engine", {})
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"not a settings file: {path}: {e}") from e
        own = {k: str(v) for k, v in settings.items()}
        names = {f"{prefix}_{k}".upper(): k for k in cls.__dataclass_fields__}
        own |= {names[k.upper()]: v for k, v in (os.environ if environment is None else environment).items() if k.upper() in names}
        return cls.parse(**own)


@dataclass(frozen=True)
class Arguments:
    """cfg: path of a settings file, which must exist. ti: whether to only deal randomness."""

    cfg: str
    ti: bool = False

    @classmethod
    def parse(cls, words: Sequence[str]) -> Arguments:
        """From words like cfg=PATH and ti=true; anything else, and a word given twice, is an error."""
        given: dict[str, str] = {}
        for word in words:
            name, equals, value = word.partition("=")
            if not equals or name not in ("cfg", "ti") or name in given:
                raise ValueError(f"not understood: {word}")
            given[name] = value
        if "cfg" not in given:
            raise ValueError("cfg=PATH is missing")
        if not Path(given["cfg"]).is_file():
            raise ValueError(f"no such file: {given['cfg']}")
        if given.get("ti", "false") not in ("true", "false"):
            raise ValueError(f"ti is true or false: {given['ti']}")
        return cls(given["cfg"], given.get("ti") == "true")
