"""Keyword dictionaries as data: loading, validation and hot reload.

A dictionary directory holds ``categories.yaml`` (the ordered index) and one YAML file per category.
Everything here is small, driver-side configuration. ``RuleSet`` is what the column builders in
``docsieve.functions`` turn into literals; no document ever passes through this module.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

log = logging.getLogger(__name__)

BUNDLED = Path(__file__).resolve().parent / "dictionaries"


class RuleError(ValueError):
    """A dictionary file does not describe a usable category."""


@dataclass(frozen=True)
class FieldPattern:
    field: str
    pattern: str
    group: int = 1


@dataclass(frozen=True)
class Category:
    slug: str
    display_name: str
    threshold: float
    description: str = ""
    primary_weight: int = 2
    secondary_weight: int = 1
    min_primary: int = 2
    primary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    exclusion: tuple[str, ...] = ()
    patterns: tuple[FieldPattern, ...] = ()
    mandatory: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def all_keywords(self) -> list[str]:
        return [k.lower() for k in (*self.primary, *self.secondary)]

    @property
    def max_score(self) -> int:
        return len(self.primary) * self.primary_weight + len(self.secondary) * self.secondary_weight


@dataclass(frozen=True)
class RuleSet:
    """Enabled categories in index order; the position in the tuple decides ties."""

    categories: tuple[Category, ...] = ()

    def __iter__(self) -> Iterator[Category]:
        return iter(self.categories)

    def __len__(self) -> int:
        return len(self.categories)

    @property
    def slugs(self) -> list[str]:
        return [c.slug for c in self.categories]

    def get(self, slug: str) -> Category | None:
        return next((c for c in self.categories if c.slug == slug), None)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise RuleError(message)


def _strings(raw: dict, key: str) -> tuple[str, ...]:
    values = raw.get(key, [])
    _need(isinstance(values, list), f"{key} must be a list")
    _need(all(isinstance(v, str) for v in values), f"{key} must hold strings")
    return tuple(values)


def _keywords(raw: dict, key: str) -> tuple[str, ...]:
    values = raw.get(key, [])
    _need(isinstance(values, list), f"{key} must be a list")
    return tuple(str(v).lower() for v in values)


def _integer(raw: dict, key: str, default: int) -> int:
    value = raw.get(key, default)
    _need(isinstance(value, int) and not isinstance(value, bool), f"{key} must be an integer")
    return value


def drop_layout_whitespace(pattern: str) -> str:
    """Treat a multi-line pattern as verbose: whitespace outside classes and escapes is layout."""
    if "\n" not in pattern:
        return pattern
    return re.sub(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\])|\s+", lambda m: m.group(1) or "", pattern)


def _patterns(raw: dict, verbose_multiline: bool) -> tuple[FieldPattern, ...]:
    entries = raw.get("regex_patterns") or {}
    _need(isinstance(entries, dict), "regex_patterns must be a mapping")
    out = []
    for name, spec in entries.items():
        spec = spec if isinstance(spec, dict) else {"pattern": spec}
        text, group = spec.get("pattern"), spec.get("group", 1)
        _need(isinstance(text, str), f"pattern of {name} must be a string")
        _need(isinstance(group, int), f"group of {name} must be an integer")
        if verbose_multiline:
            text = drop_layout_whitespace(text)
        try:
            groups = re.compile(text, re.IGNORECASE).groups
        except re.error as exc:
            raise RuleError(f"pattern of {name} does not compile: {exc}") from exc
        if 0 <= group <= groups:
            out.append(FieldPattern(str(name), text, group))
        else:
            log.warning("field %s asks for group %d of %d and is never extracted", name, group, groups)
    return tuple(out)


def parse_category(raw: dict, slug: str | None = None, *, verbose_multiline: bool = False) -> Category:
    """Build a category from the mapping in its YAML file. The index slug wins over the file's."""
    _need(isinstance(raw, dict), "a dictionary file must hold a mapping")
    _need(isinstance(raw.get("category"), str), "category is required")
    _need(isinstance(raw.get("display_name"), str), "display_name is required")
    threshold = raw.get("confidence_threshold")
    _need(isinstance(threshold, (int, float)) and 0.0 <= threshold <= 1.0,
          "confidence_threshold must lie in [0, 1]")
    scoring = raw.get("scoring", {})
    _need(isinstance(scoring, dict), "scoring must be a mapping")
    return Category(
        slug=slug or raw["category"],
        display_name=raw["display_name"],
        threshold=float(threshold),
        description=raw.get("description", ""),
        primary_weight=_integer(scoring, "primary_weight", 2),
        secondary_weight=_integer(scoring, "secondary_weight", 1),
        min_primary=_integer(scoring, "min_primary_matches", 2),
        primary=_keywords(raw, "primary_keywords"),
        secondary=_keywords(raw, "secondary_keywords"),
        exclusion=_keywords(raw, "exclusion_keywords"),
        patterns=_patterns(raw, verbose_multiline),
        mandatory=_strings(raw, "mandatory_fields"),
        optional=_strings(raw, "optional_fields"),
    )


# Keywords that the corrected variant reads as their author wrote them. An unquoted
# "po #" is cut to "po" by YAML, where " #" starts a comment.
CORRECTED_KEYWORDS = {("invoice", "po"): "po #", ("purchase_order", "po"): "po #"}


def _corrected(category: Category) -> Category:
    def fix(words: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(CORRECTED_KEYWORDS.get((category.slug, w), w) for w in words)

    return replace(category, primary=fix(category.primary), secondary=fix(category.secondary))


@dataclass
class RuleStore:
    """Dictionaries of one directory, re-read when a file's modification time changes.

    ``variant="standard"`` keeps every pattern and keyword exactly as YAML yields it.
    ``variant="corrected"`` strips layout whitespace from multi-line patterns, so that all their
    alternatives can match, and restores the truncated keywords above.
    """

    directory: str | Path = BUNDLED
    variant: str = "standard"
    _cache: dict[tuple[str, str], tuple[float, Category]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.variant not in ("standard", "corrected"):
            raise ValueError(f"unknown variant {self.variant!r}")
        self.directory = Path(self.directory)

    def index(self) -> list[dict]:
        path = self.directory / "categories.yaml"
        if not path.exists():
            raise FileNotFoundError(f"category index not found: {path}")
        raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        return [e for e in raw.get("categories", []) if e.get("enabled", True)]

    def load(self) -> RuleSet:
        """All enabled categories. A missing file is skipped; a broken one keeps its last good state."""
        found: dict[str, Category] = {}
        for entry in self.index():
            slug, path = entry["category"], self.directory / entry["file"]
            if not path.exists():
                log.warning("dictionary %s is missing and skipped", path)
                continue
            key, mtime = (slug, str(path)), path.stat().st_mtime
            if key not in self._cache or self._cache[key][0] != mtime:
                try:
                    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
                    category = parse_category(raw, slug, verbose_multiline=self.variant == "corrected")
                    if self.variant == "corrected":
                        category = _corrected(category)
                    self._cache[key] = (mtime, category)
                except (RuleError, yaml.YAMLError, UnicodeDecodeError) as exc:
                    log.error("dictionary %s is invalid: %s", path, exc)
            if key in self._cache:
                found[slug] = self._cache[key][1]
        return RuleSet(tuple(found.values()))

    def get(self, slug: str) -> Category | None:
        return self.load().get(slug)

    def reload(self) -> RuleSet:
        """Forget every cached file and read the directory again."""
        self._cache.clear()
        return self.load()


def load_rules(directory: str | Path = BUNDLED, variant: str = "standard") -> RuleSet:
    return RuleStore(directory, variant).load()
