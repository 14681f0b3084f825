"""The validated configuration, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

_BOUNDS = {
    "base_urls": (1, 100), "log_channel_size": (1000, 50_000), "cache_cap": (100, 100_000), "ticker_time_milliseconds": (500, 10_000),
    "worker_count": (50, 2000), "task_count": (100, 10_000), "max_depth_crawl": (1, 10), "ngram_count": (2, 5), "max_typo": (1, 4),
}


@dataclass
class Config:
    base_urls: list[str] = field(default_factory=list)
    index_path: str = ""
    model_sever_link: str = "hash"  # the embedder
    info_log_path: str = "-"
    error_log_path: str = "-"
    tui_border_color: str = "240"
    log_channel_size: int = 10_000
    cache_cap: int = 100
    ticker_time_milliseconds: int = 1000
    worker_count: int = 50
    task_count: int = 1000
    max_depth_crawl: int = 8
    ngram_count: int = 3
    max_typo: int = 2
    only_same_domain: bool = False

    def validate(self) -> Config:
        """Every fault at once, as one ValueError; returns itself."""
        faults = [f"{f.name} is required" for f in fields(self) if isinstance(getattr(self, f.name), (str, list)) and not getattr(self, f.name)]
        for name, (least, most) in _BOUNDS.items():
            value = getattr(self, name)
            size = len(value) if isinstance(value, list) else value
            if not least <= size <= most:
                faults.append(f"{name} must be from {least} to {most}")
        if faults:
            raise ValueError("; ".join(faults))
        return self

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            given = json.load(f)
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})
