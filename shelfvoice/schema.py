"""Column names and fixed values shared by the operators."""

from __future__ import annotations

# --- Fixed values: file formats and rules that decide results -------------
REQUIRED = ["Asin", "Title", "Content", "Model", "Rating", "Date"]
PROCESSED = ["ID", "Asin", "Brand", "Title", "Content", "Model", "Rating", "Date", "Review Type"]
TEXT_COLUMNS = ["Title", "Content", "Model"]
BRAND_REQUIRED = ["ASIN", "Brand"]
PARENT_ASIN = "Parent ASIN"
REVIEW_TYPES = ["positive", "neutral", "negative"]
NEGATIVE_MAX = 2.0
NEUTRAL_MAX = 3.0
HIGH_RATING = 4.0
LOW_RATING = 2.0
RATING_SCALE = [1, 2, 3, 4, 5]
GROUP_SEPARATOR = " - "
NOT_ENRICHABLE = ["ID", "Asin", "Brand", "Model", "Rating", "Date", "Review Type"]
TRANSLATED_NAMES = ["Content_zh", "翻译内容", "Translation", "content_zh", "translated_content"]
MIN_TEXT_LENGTH = 200
MIN_WORD_LENGTH = 3
WORD_TABLE_SIZE = 50
CLOUD_SIZE = 150
KEYWORDS_SHOWN = 10
CATEGORIES_SHOWN = 5
CHUNK_CHARS = 4000
MAX_RETRIES = 3
RETRY_PAUSE_SECONDS = 1.0
ERROR_PREVIEW_CHARS = 50
SAMPLE_PREVIEW_CHARS = 100
CACHE_TTL_DAYS = 30
# ---------------------------------------------------------------------------

REVIEW_TYPE = "Review Type"


def missing_columns(df, required) -> list[str]:
    """Required columns that the frame lacks; reads metadata only."""
    return [c for c in required if c not in df.columns]


def require_columns(df, required) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
