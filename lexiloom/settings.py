"""Settings of an installation: where its stores are. A file of KEY=VALUE lines first, the environment over it."""
from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """store_path: folder of the relational tables and the lexicon. index_path, index_name: folder of the search documents."""

    store_path: str = "concordance/store"
    index_path: str = "concordance/index"
    index_name: str = "segments"

    @property
    def documents(self) -> str:
        return f"{self.index_path.rstrip('/')}/{self.index_name}"


def load(path: str = ".env", environ: Mapping[str, str] | None = None) -> Settings:
    """Settings by name in capitals (STORE_PATH, INDEX_PATH, INDEX_NAME). A missing file sets nothing; blank lines, lines that
    begin with # and names that are no setting are left out; quotes around a value go; an empty value sets nothing."""
    known = {f.name for f in fields(Settings)}
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, is_set, value = line.partition("=")
                if is_set and not line.lstrip().startswith("#"):
                    found[name.strip().lower()] = value.strip().strip("\"'")
    found |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items() if v}
    return Settings(**{k: v for k, v in found.items() if k in known and v})
