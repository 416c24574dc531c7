"""Settings: a tree of values from YAML or JSON, read by dotted names."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from functools import reduce
from pathlib import Path
from typing import Any


class MissingSetting(ValueError):
    """A value that has no default and was not given."""


class Settings:
    """Read-only. A name that is absent or null has the default; ``False`` and 0 are values."""

    __slots__ = ("_tree", "source")

    def __init__(self, tree: Mapping[str, Any], source: str = "settings"):
        if not isinstance(tree, Mapping):
            raise ValueError(f"{source}: a mapping is expected")
        self._tree, self.source = copy.deepcopy(dict(tree)), source

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls(json.loads(text or "{}"), str(path))
        import yaml

        return cls(yaml.safe_load(text) or {}, str(path))

    def get(self, name: str, default: Any = None) -> Any:
        found = reduce(lambda node, part: node.get(part) if isinstance(node, Mapping) else None, name.split("."), self._tree)
        return default if found is None else copy.deepcopy(found)

    def require(self, name: str, hint: str = "") -> Any:
        found = self.get(name)
        if found is None:
            raise MissingSetting(f"{self.source} gives no value for {name}" + (f": {hint}" if hint else ""))
        return found

    def section(self, name: str) -> Settings:
        return Settings(self.get(name, {}), f"{self.source}: {name}")

    def to_dict(self) -> dict[str, Any]:
        return copy.deepcopy(self._tree)
