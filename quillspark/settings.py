"""Every tunable value, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Search:
    chunk_chars: int = 1500
    pool: int = 50
    rrf_k: int = 60
    min_cosine: float = 0.8
    results: int = 20
    max_results: int = 50
    max_query_chars: int = 500
    snippet_chars: int = 240
    snippet_lead: float = 0.3
    page: int = 50
    max_page: int = 200
    dimensions: int = 384


@dataclass(frozen=True)
class Extraction:
    date_order: str = "DMY"
    oldest_year: int = 1900
    future_days: int = 1
    scan_chars: int = 20_000
    vendor_chars: int = 80
    vendor_lines: int = 5


@dataclass(frozen=True)
class Linkage:
    """Weights of signals and cutoffs of the "B continues A" score."""

    lookback_days: int = 14
    window_s: int = 6 * 3600
    min_confidence: float = 0.5
    medium: float = 0.65
    high: float = 0.85
    model_low: float = 0.4
    model_high: float = 0.85
    model_weight: float = 3.0
    retry_s: int = 1800
    close_s: int = 120
    near_s: int = 600
    far_s: int = 3600
    similar: float = 0.85
    dissimilar: float = 0.4
    min_digits: int = 5
    letterhead_lines: int = 4
    max_pages: int = 500
    ends_chars: int = 1500
    bias: float = -2.5
    weights: dict = field(
        default_factory=lambda: {
            "timeGap": {"close": 1.5, "near": 0.25, "apart": 0.0, "far": -1.0},
            "filename": {"next": 2.0, "series": 0.5, "unrelated": -0.5},
            "pageMarkers": {"consecutive": 3.0, "sameSet": 1.0, "restart": -2.0, "complete": -1.5, "conflict": -2.0, "none": 0.0},
            "identifiers": {"shared": 1.5, "none": 0.0},
            "documentDate": {"agree": 0.5, "onlyFirst": 0.5, "conflict": -1.5, "none": 0.0},
            "vendor": {"agree": 0.5, "onlyFirst": 0.0, "conflict": -2.5, "none": 0.0},
            "textFlow": {"runsOn": 2.0, "freshStart": -1.5, "none": 0.0},
            "embedding": {"similar": 0.5, "dissimilar": -1.0, "none": 0.0},
        }
    )


@dataclass(frozen=True)
class Archive:
    trash_days: int = 30
    finished_hours: int = 24
    list_limit: int = 200
    stable_s: int = 10
    debounce_s: int = 60
    rate_attempts: int = 10
    rate_window_s: int = 900
    title_chars: int = 500
    folder_chars: int = 64
    path_depth: int = 32
    duplicates_max: int = 200
    read_chars: int = 20_000


SEARCH, EXTRACTION, LINKAGE, ARCHIVE = Search(), Extraction(), Linkage(), Archive()
