"""Fixed parameters of the registered queries (see FIXTURES.md §3).

Every reference time is explicit; nothing reads the wall clock.
"""

from datetime import datetime

# Snapshots from events: data spans 2024-01-01 .. 2024-01-30.
EVENTS_AS_OF = datetime(2024, 1, 31)
EVENTS_DAYS = 7
EVENTS_CUTOFF = "2024-01-24 00:00:00"
EVENTS_SINCE = "2024-01-28 00:00:00"  # recently pushed / similarity sources

# Snapshots from orders: data spans 1995-01-01 .. 2001-08-01.
ORDERS_AS_OF = datetime(2001, 8, 2)
ORDERS_DAYS = 30
ORDERS_CUTOFF = "2001-07-03 00:00:00"
ORDERS_SINCE = "2001-01-01 00:00:00"

SINK_MONTH = 200001
TRENDING_LIMIT = 200
CRAWLED_SINCE = "2024-02-15 00:00:00"
PAGE_SIZE = 50
HISTORY_LIMIT = 15
RECENT_LIST_LIMIT = 100
SIMILARITY_K = 10
FEED_FACET_TOPICS = ("ECONOMY", "STANDARD", "PROMO", "red", "blue", "green")
RANGE_LO, RANGE_HI, RANGE_CAP, RANGE_PAGE = 50, 1_000_000, 1000, 100
ID_PAGE_LIMIT, ID_PAGE_OFFSET = 50, 100
RANGE_ROWS = 500  # rows of a stored range, small so that the test tables have several
SNIPPET_CHARS = 400
POST_LIMIT_BYTES = 270
BASE_URL = "https://example.org"
README_BASE = "https://raw.githubusercontent.com"

# Facet request used by the facet queries (OR within a facet, AND across).
FACET_LANGUAGES = ("AF", "NO")
FACET_TAGS = ("Brand#13", "Brand#22", "v10", "v20", "v30")
FACET_TOPICS = ("ECONOMY", "STANDARD", "red", "blue")
