"""Settings: frozen values on the driver, inlined into plans as literals."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


# The defaults and the profiles are fixed values.


@dataclass(frozen=True)
class OcrSettings:
    tesseract_cmd: str = ""
    dpi: int = 300
    image_format: str = "PNG"
    enhance_images: bool = True
    page_seg_mode: int = 6
    preferred_engine: str = ""
    pages_per_task: int = 0  # 0: a task renders a whole document


@dataclass(frozen=True)
class AiSettings:
    model: str = "default"
    temperature: float = 0.1
    max_tokens: int = 2048
    min_confidence: float = 30.0
    max_retries: int = 3
    retry_delay: float = 1.0
    max_concurrent: int = 4
    seconds_between_calls: float = 0.0
    ask_again_below: float = 0.0  # fields that score lower are asked for once more


@dataclass(frozen=True)
class ValidationSettings:
    min_loan_amount: float = 10_000.0
    max_loan_amount: float = 10_000_000.0
    nmls_min_length: int = 4
    nmls_max_length: int = 8
    required_fields: tuple[str, ...] = ("borrowers", "loan_amount", "lender_name")


@dataclass(frozen=True)
class ProcessingSettings:
    batch_size: int = 10
    save_intermediates: bool = False
    log_level: str = "INFO"
    output_format: str = "json"


@dataclass(frozen=True)
class Settings:
    ocr: OcrSettings = OcrSettings()
    ai: AiSettings = AiSettings()
    validation: ValidationSettings = ValidationSettings()
    processing: ProcessingSettings = ProcessingSettings()
    api_key: str | None = None

    def to_dict(self) -> dict:
        """Nested values without the key."""
        out = asdict(self)
        out.pop("api_key")
        return out

    def api_config(self) -> dict:
        """What a language-model client needs; raises without a key."""
        if not self.api_key:
            raise ValueError("no API key is set")
        return {"api_key": self.api_key, **asdict(self.ai)}

    def ocr_config(self) -> dict:
        """What an OCR engine needs."""
        return asdict(self.ocr)


#: Environment variable -> (section, setting, type).
ENVIRONMENT = {
    "TESSERACT_CMD": ("ocr", "tesseract_cmd", str),
    "OCR_DPI": ("ocr", "dpi", int),
    "GEMINI_MODEL": ("ai", "model", str),
    "MIN_AI_CONFIDENCE": ("ai", "min_confidence", float),
    "LOG_LEVEL": ("processing", "log_level", str),
}
API_KEY = "GOOGLE_API_KEY"

#: Fixed values.
PROFILES = {
    "development": {
        "ocr": {"dpi": 150, "enhance_images": False},
        "ai": {"min_confidence": 20.0, "max_retries": 2, "retry_delay": 1.0},
        "processing": {"save_intermediates": True, "log_level": "DEBUG"},
    },
    "production": {
        "ocr": {"dpi": 300, "enhance_images": True},
        "ai": {"min_confidence": 50.0, "max_retries": 3, "retry_delay": 1.0},
        "processing": {"save_intermediates": False, "log_level": "INFO"},
    },
    "high_accuracy": {
        "ocr": {"dpi": 600, "enhance_images": True},
        "ai": {"min_confidence": 70.0, "max_retries": 5, "retry_delay": 2.0},
        "processing": {"save_intermediates": True, "log_level": "DEBUG"},
    },
}


def merged(settings: Settings, sections: dict) -> Settings:
    """Settings with the known values of ``sections``; unknown ones are ignored."""
    for section, values in sections.items():
        part = getattr(settings, section, None)
        if part is None or not isinstance(values, dict):
            continue
        known = {f.name for f in fields(part)}
        settings = replace(settings, **{section: replace(part, **{k: v for k, v in values.items() if k in known})})
    return settings


def from_environment(env: dict[str, str] | None = None) -> Settings:
    """Defaults, overridden by environment variables."""
    env = os.environ if env is None else env
    settings = Settings(api_key=env.get(API_KEY) or None)
    for name, (section, key, kind) in ENVIRONMENT.items():
        if env.get(name):
            settings = merged(settings, {section: {key: kind(env[name])}})
    return settings


def load(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Environment, then profile, then file; a bad file leaves the rest as it is."""
    settings = merged(from_environment(env), PROFILES.get(profile or "", {}))
    if path:
        try:
            settings = merged(settings, json.loads(Path(path).read_text()))
        except (OSError, ValueError) as e:
            print(f"warning: {path} not used: {e}")
    return settings


def validate(settings: Settings) -> dict:
    """``{is_valid, issues}`` of the settings."""
    issues = []
    if not settings.api_key:
        issues.append("API key is not set")
    if not 72 <= settings.ocr.dpi <= 600:
        issues.append("OCR resolution must be between 72 and 600")
    if not 0 <= settings.ai.temperature <= 2:
        issues.append("temperature must be between 0 and 2")
    if not 10 <= settings.ai.min_confidence <= 100:
        issues.append("minimum confidence must be between 10 and 100")
    if settings.ai.max_concurrent < 1 or settings.processing.batch_size < 1:
        issues.append("calls at once and batch size must be 1 or more")
    if settings.processing.output_format not in ("json", "csv"):
        issues.append("output format must be json or csv")
    if settings.ocr.tesseract_cmd and not Path(settings.ocr.tesseract_cmd).exists():
        issues.append("OCR program not found")
    return {"is_valid": not issues, "issues": issues}
