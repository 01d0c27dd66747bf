"""Thresholds, limits and word tables that decide the results."""

# --- Fixed values: duplicate thresholds by layout and level -------------------
# order inside a row: aggressive, normal, sensitive
LEVELS = ("aggressive", "normal", "sensitive")
LAYOUTS = ("bottom_bar", "full_scroll", "page_turn")
STATIC_CUT = {
    "bottom_bar": (0.045, 0.028, 0.016),
    "full_scroll": (0.026, 0.018, 0.012),
    "page_turn": (0.012, 0.008, 0.005),
}
STRUCTURE_CUT = {
    "bottom_bar": (0.085, 0.062, 0.042),
    "full_scroll": (0.052, 0.038, 0.026),
    "page_turn": (0.032, 0.024, 0.017),
}
PLAYHEAD_CUT = (0.22, 0.14, 0.09)
HASH_CUT = {
    "bottom_bar": (8, 6, 4),
    "full_scroll": (7, 5, 3),
    "page_turn": (3, 2, 1),
}
SCROLL_MIN = (5.4, 3.2, 1.8)
RING = 8
CHANGE_CUT = 22
NEAR_SAME_CUT = 5.8
COMPARE_HEIGHT, COMPARE_WIDTH = 900, 1600
SHIFT_HEIGHT, SHIFT_WIDTH = 1200, 1400
MIN_COMPARE_SIDE = 16
MIN_NEAR_SAME_SIDE = 24
SCROLL_CONFIDENCE = 0.34
DIRECTION_CONFIDENCE = 0.4
JITTER_FACTOR = 1.8

# --- Fixed values: moving-bar test --------------------------------------------
BAR_BOX_WIDTH, BAR_BOX_HEIGHT, BAR_SHARE = 0.22, 0.42, 0.25
BAR_COLUMN_DENSITY, BAR_SPAN, BAR_CONCENTRATION = 0.45, 0.16, 0.52

# --- Fixed values: overlap ----------------------------------------------------
# layout -> (base, slope, low, high)
EFFECTIVE_OVERLAP = {
    "bottom_bar": (0.50, 0.52, 0.56, 0.90),
    "full_scroll": (0.55, 0.58, 0.62, 0.94),
    "page_turn": (0.68, 0.28, 0.74, 0.97),
}
EFFECTIVE_OVERLAP_OTHER = (0.54, 0.56, 0.60, 0.92)
SHIFT_MIN_SEGMENT = 24
MERGE_ACCEPT = 19.5
MERGE_GAP = 12
STITCH_SEAM_MIN, STITCH_SEAM_MAX = 10, 42
# Rows of a stitched sheet that a fold holds as they are (a limit of this library).
SHEET_ROWS = 16_384

# --- Fixed values: ink and page checks ----------------------------------------
INK_BLOCK, INK_OFFSET = 31, 7
EDGE_HIT, SPARSE = 0.058, 0.018
PAGE_EDGE_ROWS, PAGE_EDGE_CUT = 48, 0.020
CONTENT_CUT = 0.003

# --- Fixed values: pagination -------------------------------------------------
PAGE_RATIO = 1.0 / 1.4142
PAGINATION = {
    "performance": dict(
        single=0.94, soft=1.02, hard=1.10, underfill=0.90, min_page=0.74, back=0.14, forward=0.28,
        back_blank=0.82, back_ratio=0.72, tail=0.42, tail_hard=1.18, tail_soft=1.24,
    ),
    "balanced": dict(
        single=0.97, soft=0.93, hard=0.93, underfill=0.0, min_page=0.58, back=0.28, forward=0.20,
        back_blank=1.0, back_ratio=0.82, tail=0.22, tail_hard=1.08, tail_soft=1.16,
    ),
}
OVERSIZE = 1.32
SEAM_RADIUS, SEAM_CLEAR, SEAM_DISTANCE, SEAM_GAIN = 12, 0.0105, 0.00018, 0.92

# --- Fixed values: capture presets --------------------------------------------
# name, sensitivity, stitch, overlap, upscale, upscale factor
PRESETS = [
    ("basic", "medium", False, 0.2, False, 2.0),
    ("scroll", "low", True, 0.26, False, 2.0),
    ("quality", "high", False, 0.2, True, 3.0),
]
# sensitivity, frames per second, duplicate level
SENSITIVITY = [("low", 0.6, "aggressive"), ("medium", 1.0, "normal"), ("high", 1.8, "sensitive")]

# --- Fixed values: sources, files, roles --------------------------------------
SOURCE_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "webm", "avi")
CAPTURE_SUFFIXES = ("png", "jpg", "jpeg")
FORMATS = ("png", "jpg", "jpeg", "pdf")
LOW_HEIGHT, LOW_WIDTH = 360, 640
SEEK_OFFSETS = (0.0, 0.8, 1.8, 3.5, 6.0)
SEEK_BACK = (-1.0, -3.0)
SEEK_BACK_FROM = 1.5
SEEK_WINDOW = 12.0
ROI_SAMPLE_OFFSETS = (0.0, 0.8, 1.6)
THUMBNAIL_BATCH = 90
PDF_MAX_EDGE = 2400


def by_level(values, level: str):
    """Pick from an (aggressive, normal, sensitive) row; anything else counts as normal."""
    return values[LEVELS.index(level)] if level in LEVELS else values[1]
