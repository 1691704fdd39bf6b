"""The salary-listing flow on a text file: parse, set aside bad lines, summarise by location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import lines as text
from ledgerlight.operators.cleaning import equals_filter
from ledgerlight.operators.sampling import bernoulli_sample
from ledgerlight.sources import readers, sinks
from ledgerlight.sources.schemas import LISTINGS


def parse(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Typed listings in ``silver/listings``, bad lines in ``bronze/listing_rejects``."""
    header = readers.first_line(spark, path)
    lines = readers.read_lines(spark, path)
    valid, rejects = text.parse_lines(lines, LISTINGS, header=header)
    sinks.write_parquet(valid, sinks.layer_path(base, "silver", "listings"))
    sinks.write_parquet(rejects, sinks.layer_path(base, "bronze", "listing_rejects"))
    sinks.write_records(
        text.line_report(lines, LISTINGS, header=header), sinks.layer_path(base, "logs", "listing_report")
    )
    return readers.read_parquet(spark, sinks.layer_path(base, "silver", "listings"))


def reports(listings: DataFrame) -> dict[str, DataFrame]:
    """The summaries by location, the word counts and the two status groups."""
    full_time, interns = (equals_filter(listings, "Employment Status", s) for s in ("Full Time", "Intern"))
    return {
        "title_words": text.token_counts(listings, "Job Title"),
        "full_time_share": agg.share(listings, F.col("Employment Status") == "Full Time"),
        "company_salaries": listings.select("Company Name", "Salary"),
        "sample": bernoulli_sample(listings, 0.05),
        "full_time_and_interns": agg.bag_union(full_time, interns),
        "total_by_location": agg.key_totals(listings, "Location", "Salary"),
        "values_by_location": agg.key_values(listings, "Location", "Salary"),
        "ranges_by_location": agg.key_ranges(listings, "Location", "Salary"),
        "top_8_locations": agg.key_counts(listings, "Location", top=8),
        "average_by_location": agg.key_averages(listings, "Location", "Salary"),
        "uplift_by_location": agg.key_totals(listings, "Location", "Salary", factor=1.1),
    }
