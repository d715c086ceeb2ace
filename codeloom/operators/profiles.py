"""Profiles: which entities and relations a context query gives, how it ranks them and how many."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    name: str
    description: str = ""
    preferred_entities: tuple[str, ...] = ("File", "Symbol")
    preferred_relations: tuple[str, ...] = ("contains", "imports")
    include_conventions: bool = False
    include_risks: bool = False
    include_related_files: bool = True
    max_items: int = 50
    ranking_mode: str = "relevance"
    summary_levels: tuple[str, ...] = ("file", "symbol")
    semantic_search_enabled: bool = True

    @classmethod
    def of(cls, data: dict) -> Profile:
        """A profile of a mapping; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known})


DEFAULTS = {
    p.name: p
    for p in (
        Profile("review-agent", "Reviews of changes", ("File", "Symbol", "Relation"), ("imports", "calls", "depends_on"), True, True, True, 50, "dependency_depth"),
        Profile("dev-agent", "Development", ("Module", "Symbol", "File"), ("contains", "imports", "depends_on", "inherits"), True, False, True, 100, "breadth_first"),
        Profile("doc-agent", "Documentation", ("Module", "File", "Symbol"), ("contains", "imports"), True, False, False, 80, "relevance"),
    )
}


@dataclass
class Registry:
    """Profiles by name: kept ones first, then files of the folder, then the defaults."""

    folder: Path | None = None
    cache: dict[str, Profile] = field(default_factory=dict)

    def _path(self, name: str) -> Path | None:
        return Path(self.folder) / f"{name}.yaml" if self.folder else None

    def get(self, name: str) -> Profile | None:
        if name not in self.cache:
            path = self._path(name)
            if path and path.exists():
                import yaml

                self.cache[name] = Profile.of(yaml.safe_load(path.read_text()))
            elif name in DEFAULTS:
                self.cache[name] = DEFAULTS[name]
        return self.cache.get(name)

    def names(self) -> list[str]:
        saved = {p.stem for p in Path(self.folder).glob("*.yaml")} if self.folder and Path(self.folder).exists() else set()
        return sorted(saved | set(DEFAULTS))

    def save(self, profile: Profile) -> None:
        import yaml

        path = self._path(profile.name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(profile).items()}, sort_keys=False))
        self.cache[profile.name] = profile
