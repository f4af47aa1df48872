"""Result texts."""

# --- fixed values: texts and templates that callers compare against -------------
NO_SUCH_AREA = "%s event area does not exist"
NO_STRATEGY = "%s reservation strategy is not implemented"
BAD_COUNT = "%d continuous seats is invalid"
NO_RUN = "no continuous %d seats at area %s in event %s"
BAD_SEAT = "%s (%d, %d) is not a valid seat."
SEAT_TAKEN = "%s (%d, %d) is unavailable."
TYPE_NOT_SUPPORTED = "%s type reservation is not supported"
REJECTED_EARLY = "request rejected at cache level"
# --------------------------------------------------------------------------------

