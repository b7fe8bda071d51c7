"""Settings of a crawl and what is kept of a discovery run, as JSON or YAML files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

try:
    import yaml
except ImportError:  # YAML is optional
    yaml = None


@dataclass
class CrawlConfig:
    urls: list[str] = field(default_factory=list)
    file_extensions: list[str] = field(default_factory=lambda: [".html", ".pdf", ".doc", ".md"])
    output_dir: str = "output"
    delay: float = 1.0
    recursive: bool = True
    max_depth: int = 3
    min_year: int = 0

    @classmethod
    def load(cls, path: str | Path) -> CrawlConfig:
        """The settings of a file; unknown ones are ignored, missing ones get their defaults."""
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yaml", ".yml")):
            if yaml is None:
                raise RuntimeError("YAML settings need PyYAML; JSON ones do not")
            values = yaml.safe_load(text)
        else:
            values = json.loads(text)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known and v is not None})

    def save(self, path: str | Path) -> None:
        values = asdict(self)
        if str(path).endswith((".yaml", ".yml")) and yaml is not None:
            text = yaml.safe_dump(values, allow_unicode=True)
        else:
            text = json.dumps(values, ensure_ascii=False, indent=2)
        Path(path).write_text(text, encoding="utf-8")

    def seeds(self) -> list[str]:
        """The addresses to start from, with a scheme."""
        return [u if re.match("(https?|file)://", u) else f"https://{u}" for u in self.urls]


def confined(root: str | Path, name: str) -> Path:
    """A path below ``root``; names that lead out of it are refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if path != base and base not in path.parents:
        raise ValueError("the name leads out of the folder")
    return path
