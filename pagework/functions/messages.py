"""Texts that callers match on, each once."""

# Messages of failed requests.
FILE_NOT_FOUND = "File not found: "
NO_FILES = "No files provided."
NO_RANGES = "Page ranges are required"
NO_POINTS = "Split pages are required"
BAD_INTERVAL = "Valid page interval is required"
NO_CRITERION = "At least one removal criteria must be specified."
NOTHING_LEFT = "Cannot remove all pages from the PDF"
NO_ORDER = "Page order is required."
BAD_TURN = "Rotation must be a multiple of 90 degrees. Got: "
NO_METADATA = "Metadata is required for write operation"

# Messages of this package's own.
NO_PAGE = "Page number is missing"
NO_RANGE = "Page range is missing"
NO_POINT = "Split page is missing"
BAD_POINTS = "Split pages must be distinct and lie between 1 and "
BAD_COLOUR = "Invalid text color: "
ONE_MOVE = "Only one page can be moved at a time"
ONE_EDIT = "Only one edit per document is allowed"
TOO_LARGE = "File is too large to read: "
UNREADABLE = "Request cannot be read: "
UNKNOWN_ACTION = "Unknown action: "
