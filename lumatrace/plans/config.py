"""What a scan is to do, and the stages that do it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from ..operators.similar import PRESETS


@dataclass(frozen=True)
class ScanConfig:
    """Settings of one scan; times, sizes and thresholds in the units of the operators."""

    folder: str
    mode: str = "duplicates"  # duplicates, text_search, sample_search
    find_exact: bool = True
    find_dhash: bool = True
    find_phash: bool = True
    find_whash: bool = False
    dhash_bits: int = 8
    phash_bits: int = 8
    whash_bits: int = 2
    use_ai: bool = False
    similarity: float = 95.0
    precision: str = "balanced"
    compare_by_luminance: bool = False
    compare_by_channel: bool = False
    channels: tuple[str, ...] = ("R", "G", "B", "A")
    tags: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    query: str = ""
    sample: str = ""
    batch_size: int = 256
    workers: int = 4
    options: dict = field(default_factory=dict)

    def validate(self) -> ScanConfig:
        if not self.folder:
            raise ValueError("no folder")
        if self.mode == "text_search" and not self.query.strip():
            raise ValueError("a text search needs a query")
        if self.mode == "sample_search" and not self.sample:
            raise ValueError("a sample search needs a sample file")
        if self.batch_size <= 0 or self.workers <= 0:
            raise ValueError("batch size and workers must be positive")
        if self.precision not in PRESETS:
            raise ValueError(f"unknown precision {self.precision!r}")
        for bits in (self.dhash_bits, self.phash_bits, self.whash_bits):
            if not 0 <= bits <= 64:
                raise ValueError("hash thresholds lie between 0 and 64 bits")
        return self


def choose_mode(query: str = "", sample: str = "", use_ai: bool = True, model_has_text: bool = True) -> str:
    """Sample before text before duplicates; searches need a model, text one that reads text."""
    if use_ai and sample:
        return "sample_search"
    if use_ai and query.strip() and model_has_text:
        return "text_search"
    return "duplicates"


def migrate(settings: dict) -> dict:
    """Settings of older versions: unknown keys are dropped, legacy names become today's."""
    legacy = {"threshold": "similarity", "exclude": "excluded", "search_precision": "precision"}
    names = set(ScanConfig.__dataclass_fields__)
    renamed = {legacy.get(k, k): v for k, v in settings.items()}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in renamed.items() if k in names}


def save(config: ScanConfig, path: str) -> None:
    """Settings as JSON, written whole or not at all."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=1)
    os.replace(f"{path}.part", path)


def load(path: str) -> ScanConfig:
    """Settings of a file, older ones migrated; what it lacks has its default."""
    with open(path, encoding="utf-8") as f:
        return ScanConfig(**{"folder": "", **migrate(json.load(f))})


def plan(config: ScanConfig) -> list[tuple[str, float]]:
    """Stages in order, each with its share of the whole; evidence counts in this order."""
    c = config.validate()
    if c.mode != "duplicates":
        return [("discover", 0.1), ("embed", 0.7), ("search", 0.2)]
    stages = [("discover", 0.1)]
    if c.find_exact:
        stages.append(("exact", 0.2))
    stages.append(("items", 0.05))
    if c.find_dhash or c.find_phash or c.find_whash:
        stages.append(("perceptual", 0.25))
    if c.use_ai:
        stages += [("embed", 0.3), ("index", 0.1), ("link", 0.1)]
    stages.append(("cluster", 0.1))
    whole = sum(w for _, w in stages)
    return [(n, round(w / whole, 6)) for n, w in stages]
