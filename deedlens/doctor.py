"""Checks of the installation: versions, packages, programs, environment."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")
PROGRAMS = ("java", "tesseract", "pdftoppm")
VARIABLES = ("GOOGLE_API_KEY",)


def checks(env: dict[str, str] | None = None) -> dict[str, bool]:
    """Name of each check and whether it holds."""
    env = os.environ if env is None else env
    out = {"python >= 3.10": sys.version_info >= (3, 10)}
    out |= {f"package {p}": importlib.util.find_spec(p) is not None for p in PACKAGES}
    out |= {f"program {p}": shutil.which(p) is not None for p in PROGRAMS}
    return out | {f"variable {v}": bool(env.get(v)) for v in VARIABLES}


def verdict(found: dict[str, bool]) -> tuple[float, str]:
    """Share of checks that hold, in percent: pass from 90, warn from 70, else fail."""
    share = sum(found.values()) / max(1, len(found)) * 100
    return share, "pass" if share >= 90 else "warn" if share >= 70 else "fail"
