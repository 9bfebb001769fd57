"""The stateless functions on streams: hits that arrive are mined for domains as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgbeacon.functions.codes import or_empty
from orgbeacon.functions.domains import mined


def mined_stream(hits: DataFrame) -> DataFrame:
    """(inn, hit_no, pos, domain, kind) of a stream, or a table, of hits. No state and no shuffle, so no watermark either."""
    text = F.concat(or_empty("title"), F.lit(" "), or_empty("snippet"))
    return mined(hits.select("inn", "hit_no", "title", "snippet"), text).select("inn", "hit_no", "pos", "domain", "kind")
