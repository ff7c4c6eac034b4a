"""What a run was made of."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from pathlib import Path


#: When a run was made, where nobody says so: runs of the same input are the same.
FIXED_AT = "2020-01-01T00:00:00+00:00"


@dataclass(frozen=True)
class Manifest:
    run_id: str
    created_at: str
    git_sha: str
    seed: int
    config_hash: str
    snapshots: list[str] = field(default_factory=list)
    trial_ids: list[str] = field(default_factory=list)


def git_sha() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, cwd=Path(__file__).parent, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"
