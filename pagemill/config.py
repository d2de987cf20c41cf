"""Engine settings, modes and the checks that come before any reading."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from enum import Enum, IntEnum
from pathlib import Path


class ParsingMode(str, Enum):
    BASIC_OCR = "ocr_engine"
    VLM = "parse_with_vlm"
    AGENTIC = "parse_with_agent"


class RotationAngle(IntEnum):
    NONE = 0
    CLOCKWISE_90 = 90
    COUNTER_CLOCKWISE_90 = -90
    ROTATE_180 = 180


#: Languages of the offline recogniser and the script model each of them needs.
OCR_LANGUAGES = {"english": "en", "latin": "latin", "chinese": "ch", "korean": "korean", "arabic": "arabic", "hindi": "devanagari", "tamil": "ta", "telugu": "te"}


@dataclass(frozen=True)
class EngineConfig:
    """Every setting of the engine; frozen, so that stages can close over it."""

    base_url: str | None = None
    model_name: str | None = None
    api_key: str | None = None
    temperature: float = 0.7
    max_tokens: int = 4096
    timeout: float = 300.0
    max_retries: int = 3
    retry_delay: float = 2.0
    system_prompt: str | None = None
    max_reflect_cycles: int = 2
    ocr_language: str = "english"
    ocr_model_dir: str | None = None
    ocr_model_url: str | None = None
    dpi: float = 300
    enable_crop: bool = True
    padding_size: int = 10
    row_ink_ratio: float = 0.002
    column_ink_ratio: float = 0.01
    footer_gap: int = 100
    ignore_bottom_percent: float = 12
    max_crop_percent: float = 30
    enable_rotate: bool = True
    rotate_aggressive_mode: bool = False
    use_aspect_fallback: bool = True
    hough_threshold: int = 200
    min_score_diff: float = 0.15
    analysis_max_size: int = 1500
    enable_deskew: bool = True
    deskew_border: str = "ink"
    post_crop_max_size: int = 1536
    max_concurrency: int = 5
    preprocess_pdf_ocr: bool = False
    debug_dir: str | None = None

    def __post_init__(self):
        if self.ocr_language not in OCR_LANGUAGES:
            raise ValueError(f"no recogniser for {self.ocr_language!r}; there are {', '.join(OCR_LANGUAGES)}")
        if self.deskew_border not in ("ink", "paper"):
            raise ValueError("deskew_border is 'ink' or 'paper'")
        if self.max_reflect_cycles > 2:
            warnings.warn(f"{self.max_reflect_cycles} reflect cycles cost several times the tokens of one", UserWarning, stacklevel=3)

    @property
    def has_client(self) -> bool:
        """A model can be called only with an address, a name and a key."""
        return bool(self.base_url and self.model_name and self.api_key)


def check_request(mode: ParsingMode, has_client: bool, schema=None, source: str = "pdf", path: str | None = None) -> None:
    """Raises for requests that can't be served. A missing file is told first."""
    if source == "pdf" and path is not None and "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    if source == "image" and mode == ParsingMode.AGENTIC:
        raise ValueError("the agentic mode takes documents, not single images")
    if schema is not None and mode != ParsingMode.VLM:
        raise ValueError("an output schema needs the vision-model mode")
    if mode != ParsingMode.BASIC_OCR and not has_client:
        raise ValueError(f"mode {mode.name} needs the model's address, name and key")
