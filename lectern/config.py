"""Thresholds of the analytics operators. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # outline
    heading_ratio: float = 1.2
    bold_heading_ratio: float = 1.05
    level1_ratio: float = 1.6
    level2_ratio: float = 1.3
    min_bookmarks: int = 3
    min_headings: int = 3
    # sections
    tiny_section_chars: int = 200
    margin_lines: int = 3
    repeat_ratio: float = 0.4
    repeat_min_pages: int = 5
    outlier_long: float = 3.0
    outlier_short: float = 0.15
    # visuals
    min_image_px: int = 50
    diagram_min_paths: int = 5
    diagram_gap: float = 30.0
    diagram_min_area: float = 5000.0
    caption_distance: float = 50.0
    math_font_share: float = 0.5
    math_symbol_share: float = 0.15
    # keywords
    top_keywords: int = 15
    confusable_overlap: float = 0.6
    # scans
    scanned_below: float = 25.0
    force_ocr_below: float = 5.0
    sample_group: int = 5
    chunk_pages: int = 50
    # retrieval and answers
    shortlist: int = 20
    top_k: int = 3
    max_features: int = 20_000
    context_chars: int = 12_000
    max_visuals: int = 1
    max_visual_bytes: int = 20 * 1024 * 1024
    accuracy_gate: float = 0.9


DEFAULTS = Settings()
