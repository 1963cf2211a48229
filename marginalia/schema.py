"""The fixed numbers of the note engine, and the marks of what it writes."""

# Limits and thresholds whose results must not change.
NEIGHBOUR_DISTANCE = 0.32
NEIGHBOUR_SCAN = 24
NEIGHBOUR_KEEP = 8
KEYPOINTS = 128
KEYPOINT_CHARS = 420
FIND_LIMIT = 5
SIMILAR_LIMIT = (1, 50, 5)  # least, most, default
SEARCH_LIMIT = (1, 50, 10)
SYNC_LIMIT = (1, 20000, 5000)
SOURCE_LIST_LIMIT = 500
SOURCE_LINK_LIMIT = 200
VECTOR_WIDTH = 1024
GENERATED_DEVICE = "generated"
BLOCK_START = "<!-- related-links:start -->"
BLOCK_END = "<!-- related-links:end -->"


def clamp(value: int | None, bounds: tuple[int, int, int]) -> int:
    least, most, default = bounds
    return max(least, min(default if value is None else value, most))
