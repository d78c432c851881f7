"""Venue names of the six venue numbers in the derived views."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VENUE_NAMES = ["monza", "monaco", "silverstone", "bahrain", "spa", "singapore"]
VENUE_SQL = "list_extract(['monza', 'monaco', 'silverstone', 'bahrain', 'spa', 'singapore'], venue + 1)"


def venue_name(venue: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VENUE_NAMES]), venue.cast("int") + 1)
