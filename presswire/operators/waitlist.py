"""The waiting list: taking in signups and exporting them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_email, strip
from .ordering import first_rows


def new_signups(submissions: DataFrame, waitlist: DataFrame) -> DataFrame:
    """First valid submission per address that is not on the list yet.

    A filled `company` marks a bot and is dropped without a trace. Of equal
    times the first in `position` order wins.
    """
    human = submissions.where(strip(F.coalesce("company", F.lit(""))) == "")
    valid = human.withColumn("email", normalize_email(F.col("email"))).where(F.col("email").isNotNull())
    first = first_rows(valid, ["email"], [F.col("created_at"), F.col("position")])
    return first.join(waitlist.select("email"), "email", "left_anti").select(
        "email", "created_at", "source", F.lit(None).cast("string").alias("emailed_at"))


def export_signups(waitlist: DataFrame) -> DataFrame:
    return waitlist.select("email", "created_at", "emailed_at").orderBy("created_at", "email")


def unsent_count(waitlist: DataFrame) -> DataFrame:
    return waitlist.agg(F.count(F.lit(1)).alias("signups"), F.count_if(F.col("emailed_at").isNull()).alias("unsent"))
