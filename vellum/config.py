"""Settings of the restoration stages; each default is a fixed value of the format."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DedupConfig:
    search_ratio: float = 0.7
    repeated_line_threshold: float = 0.5
    repeated_line_min_pages: int = 4
    repeated_line_min_block: int = 3


@dataclass(frozen=True)
class LLMConfig:
    provider: str = "cloud"
    model: str = ""
    max_chars_per_segment: int = 8000
    segment_overlap_lines: int = 5
    max_retries: int = 2
    timeout: int = 600
    enable_final_refine: bool = True
    enable_gap_fill: bool = True
    truncation_ratio_threshold: float = 0.3
    truncation_min_input_lines: int = 20
    max_concurrent_requests: int = 3


@dataclass(frozen=True)
class PIIConfig:
    enable: bool = False
    phone: bool = True
    email: bool = True
    id_card: bool = True
    bank_card: bool = True
    person_name: bool = True
    org_name: bool = True
    phone_placeholder: str = "[手机号]"
    email_placeholder: str = "[邮箱]"
    id_card_placeholder: str = "[身份证号]"
    bank_card_placeholder: str = "[银行卡号]"
    person_placeholder: str = "[人名]"
    org_placeholder: str = "[机构名]"
    custom_placeholder: str = "[敏感词]"
    custom_words: tuple[tuple[str, str], ...] = ()
    block_on_detect_failure: bool = True


@dataclass(frozen=True)
class ColumnConfig:
    chrome_y: int = 80
    min_y_spread: int = 300
    left_max_x1: int = 100
    left_max_x2: int = 220
    right_min_x1: int = 800
    right_max_width: int = 200
    left_pad: int = 20
    right_pad: int = 20
    filter_pad: int = 40
    full_width: int = 700
    reject_ratio: float = 0.3
    min_reject: int = 3
    min_ratio: float = 0.2
    max_ratio: float = 0.95
    coord_range: int = 999
    min_sidebar: int = 5
