"""Settings from the environment: what can't be read leaves the default."""

from __future__ import annotations

from collections.abc import Mapping

TRUE = {"1", "true", "yes", "on"}  # fixed values


def flag(environment: Mapping[str, str], name: str, default: bool = False) -> bool:
    """A switch: on for one of a few words in any case; off for any other, so that a typing error switches nothing on."""
    value = environment.get(name)
    return default if value is None else value.strip().lower() in TRUE


def positive(environment: Mapping[str, str], name: str, default: int) -> int:
    """A whole number of at least 1."""
    try:
        value = int(environment.get(name, ""))
    except ValueError:
        return default
    return value if value >= 1 else default
