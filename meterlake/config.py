"""Settings of the usage log: defaults, coercion, and where they may stand in a YAML document."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, fields, replace

# The section's name in a YAML document, and words for true and false there.
PLUGIN = "usage-statistics"
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


@dataclass(frozen=True)
class Settings:
    max_details_per_model: int = 5000
    retention_days: int = 30
    dedup_window_minutes: int = 1440
    log_response_headers: str = ""
    api_key_hash_salt: str = ""
    storage_enabled: bool = False
    storage_path: str = "usage-statistics.jsonl"
    storage_flush_interval_seconds: int = 30
    price_storage_path: str = "usage-statistics-prices.json"
    update_enabled: bool = False
    update_version: str = "latest"

    def patched(self, **values) -> Settings:
        """Other settings; None leaves one as it is, and so does an empty salt."""
        given = {k: v for k, v in values.items() if v is not None and not (k == "api_key_hash_salt" and v == "")}
        return replace(self, **given)

    def public(self) -> dict:
        """What an export or status may show: everything but the salt."""
        return {k: v for k, v in asdict(self).items() if k != "api_key_hash_salt"}


def as_int(value) -> int | None:
    """Whole non-negative numbers, also as float or text; else None."""
    if isinstance(value, bool):
        return None
    if isinstance(value, float):
        value = int(value) if math.isfinite(value) and value == int(value) else None
    elif isinstance(value, str):
        value = int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else None
    return value if isinstance(value, int) and value >= 0 else None


def as_bool(value) -> bool | None:
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    return True if word in TRUE else False if word in FALSE else None


def as_text(value) -> str | None:
    return value.strip() if isinstance(value, str) else None


_COERCE = {"int": as_int, "bool": as_bool, "str": as_text}


def section(document: dict) -> dict:
    """The plugin's values: under plugins.configs, configs, its own name, or at the root, in that order."""

    def below(d, *path):
        for p in path:
            d = d.get(p) if isinstance(d, dict) else None
        return d if isinstance(d, dict) else None

    for path in (("plugins", "configs", PLUGIN), ("configs", PLUGIN), (PLUGIN,)):
        if (found := below(document, *path)) is not None:
            return found
    return document


def read_settings(yaml_text: str) -> Settings:
    """Settings of a YAML text. Keys that are missing, or have a value of a wrong kind, keep their default."""
    import yaml

    document = yaml.safe_load(yaml_text) if yaml_text.strip() else {}
    values = section(document if isinstance(document, dict) else {})
    got = {}
    for f in fields(Settings):
        if f.name in values and (value := _COERCE[str(f.type)](values[f.name])) is not None:
            got[f.name] = value
    return Settings(**got)
