from . import basic, extended
from .model import Rule

PROFILES: dict[str, list[Rule]] = {"extended": extended.RULES, "basic": basic.RULES}


def profile_rules(profile: str, groups: tuple[str, ...] | None = None) -> list[Rule]:
    """Rules of a profile, or of some of its groups; emission order is kept."""
    return [r for r in PROFILES[profile] if groups is None or r.group in groups]
