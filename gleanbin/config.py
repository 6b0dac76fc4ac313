"""Configuration: JSON with # comment lines, as attributes."""

from __future__ import annotations

import json
from types import SimpleNamespace


def parse(text: str, sections: tuple[str, ...] = ()) -> SimpleNamespace:
    """Nested attributes of a configuration; "true" and "false" are booleans; each of sections must be there."""
    plain = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#"))
    found = json.loads(plain)
    if missing := [s for s in sections if s not in found]:
        raise ValueError(f"the configuration has no {', '.join(missing)}")

    def attributes(v):
        if isinstance(v, dict):
            return SimpleNamespace(**{k: attributes(x) for k, x in v.items()})
        if isinstance(v, str) and v.lower() in ("true", "false"):
            return v.lower() == "true"
        return v

    return attributes(found)


def load(path: str, sections: tuple[str, ...] = ()) -> SimpleNamespace:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), sections)
