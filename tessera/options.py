"""Options of a layout: defaults, presets, profiles from files, and their checks."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields, replace

MODES, GOALS = ("compact", "pot", "fast", "grid"), ("gpu", "space")
ORDERS = ("height", "width", "area", "maxside", "perimeter")
DEDUP = ("none", "exact", "perceptual")
PRESETS = {"fast": ("fast", "gpu"), "quality": ("compact", "gpu"), "small": ("compact", "space"), "pot": ("pot", "gpu")}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")

#: The profiles that are there without a file.
PROFILES = """
[profile fast]
mode=fast
[profile desktop]
mode=compact
max_width=8192
max_height=8192
padding=2
trim_transparent=true
[profile mobile]
mode=compact
max_width=2048
max_height=2048
padding=2
trim_transparent=true
[profile legacy]
mode=pot
max_width=2048
max_height=2048
padding=1
trim_transparent=true
[profile space]
mode=compact
optimize=space
rotate=true
trim_transparent=true
[profile css]
mode=compact
optimize=space
[profile grid]
mode=grid
"""


@dataclass(frozen=True)
class LayoutOptions:
    mode: str = "fast"
    optimize: str = "gpu"
    max_width: int | None = None
    max_height: int | None = None
    padding: int = 0
    extrude: int = 0
    source_resolution: tuple[int, int] | None = None
    target_resolution: tuple[int, int] | None = None
    resolution_reference: str = "largest"
    scale: float = 1.0
    trim_transparent: bool = False
    rotate: bool = False
    multipack: bool = False
    deduplicate: str = "none"
    dedup_threshold: int = 5
    sort: str | None = None  #: name, none, or stable with an order behind a colon
    incremental: bool = False

    def __post_init__(self) -> None:
        checks = {
            f"mode {self.mode}": self.mode in MODES,
            f"optimize {self.optimize}": self.optimize in GOALS,
            f"deduplicate {self.deduplicate}": self.deduplicate in DEDUP,
            f"dedup_threshold {self.dedup_threshold}": 0 <= self.dedup_threshold <= 64,
            f"scale {self.scale}": 0 < self.scale <= 1,
            f"padding {self.padding}, extrude {self.extrude}": self.padding >= 0 and self.extrude >= 0,
            f"limits {self.max_width}, {self.max_height}": all(v is None or v > 0 for v in (self.max_width, self.max_height)),
            f"resolution_reference {self.resolution_reference}": self.resolution_reference in ("largest", "smallest"),
            "one resolution without the other": (self.source_resolution is None) == (self.target_resolution is None),
            f"sort {self.sort}": self.sort in (None, "name", "none", "stable", *(f"stable:{o}" for o in ORDERS)),
        }
        if wrong := [what for what, fine in checks.items() if not fine]:
            raise ValueError("; ".join(wrong))

    @property
    def whole_scale(self) -> float:
        """The scale with the ratio of the resolutions: that of the larger or the smaller axis."""
        if self.source_resolution is None or self.target_resolution is None:
            return self.scale
        ratios = [t / s for s, t in zip(self.source_resolution, self.target_resolution, strict=True)]
        return self.scale * (max(ratios) if self.resolution_reference == "largest" else min(ratios))

    @property
    def order(self) -> tuple[str | None, bool]:
        """The enforced order, if any, and whether ties go to the natural path order."""
        if self.sort is None:
            return None, False
        kind, _, by = self.sort.partition(":")
        return (by or "height", True) if kind == "stable" else (kind, False)


def parse_bool(text: str) -> bool:
    low = text.strip().lower()
    if low not in TRUE + FALSE:
        raise ValueError(f"{text!r} is neither true nor false")
    return low in TRUE


def parse_resolution(text: str) -> tuple[int, int]:
    found = re.fullmatch(r"([0-9]+)[xX]([0-9]+)", text.strip())
    if not found or not int(found[1]) or not int(found[2]):
        raise ValueError(f"{text!r} is no WxH")
    return int(found[1]), int(found[2])


def parse_colour(text: str) -> tuple[int, ...]:
    """#RGB, #RRGGBB, rgb(r,g,b), r,g,b or r,g,b,a."""
    text = text.strip()
    if short := re.fullmatch(r"#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])", text):
        return tuple(int(c * 2, 16) for c in short.groups())
    if long := re.fullmatch(r"#([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", text):
        return tuple(int(c, 16) for c in long.groups())
    inner = re.fullmatch(r"rgb\((.*)\)", text)
    parts = [p.strip() for p in (inner[1] if inner else text).split(",")]
    if len(parts) not in ((3,) if inner else (3, 4)) or not all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts):
        raise ValueError(f"{text!r} is no colour")
    return tuple(map(int, parts))


def typed(name: str, text: str) -> object:
    kind = {f.name: str(f.type) for f in fields(LayoutOptions)}[name]
    if "bool" in kind:
        return parse_bool(text)
    if "tuple" in kind:
        return parse_resolution(text)
    return int(text) if "int" in kind else float(text) if "float" in kind else text.strip()


def parse_profiles(text: str) -> dict[str, dict]:
    """Options by profile of `[profile NAME]` sections of `key=value` lines; # and ; begin comments."""
    out: dict[str, dict] = {}
    known = {f.name for f in fields(LayoutOptions)}
    here: dict | None = None
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if head := re.fullmatch(r"\[profile\s+(.+?)\s*\]", line):
            here = out.setdefault(head[1], {})
            continue
        key, eq, value = (p.strip() for p in line.partition("="))
        if here is None or not eq:
            raise ValueError(f"line {n}: {line!r}")
        if key == "label":
            continue
        if key not in known:
            raise ValueError(f"line {n}: no option {key!r}")
        here[key] = typed(key, value)
    return out


def options(profile: str | None = None, preset: str | None = None, profiles: str = PROFILES, **given: object) -> LayoutOptions:
    """Defaults, then a profile, then a preset, then what is given."""
    out = LayoutOptions()
    if profile is not None:
        found = parse_profiles(profiles)
        if profile not in found:
            raise ValueError(f"no profile {profile!r}; there are {', '.join(sorted(found))}")
        out = replace(out, **found[profile])
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"no preset {preset!r}; there are {', '.join(sorted(PRESETS))}")
        out = replace(out, **dict(zip(("mode", "optimize"), PRESETS[preset], strict=True)))
    return replace(out, **given)


def as_dict(o: LayoutOptions) -> dict:
    return asdict(o)
