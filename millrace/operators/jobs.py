"""Jobs of benchmark requests: documents in order, whole, at most so many requests in a job.

The rule is sequential: a job is closed before the document that would overfill it. It runs over
(document, requests) alone, one row for each document of a benchmark run.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requests that a job aims at, the most of one document, and the name that seeds are made with.
TARGET, MOST, PROTOCOL = 8, 128, "fixed_document_jobs_v1"


def jobs_of(counts: Iterable[int], target: int = TARGET, most: int = MOST) -> list[int]:
    """The job of each document, by its number of requests."""
    out, job, held = [], 0, 0
    for n in counts:
        if n > most:
            raise ValueError(f"a document has {n} requests, more than {most}")
        if held and held + n > target:
            job, held = job + 1, 0
        held += n
        out.append(job)
    return out


def plan_jobs(documents: DataFrame, order: str, requests: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Adds ``job`` to (order, requests) rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(job=jobs_of(group[requests], target, most))[[order, requests, "job"]]

    kinds = dict(documents.dtypes)
    return documents.select(order, requests).groupBy().applyInPandas(run, f"{order} {kinds[order]}, {requests} {kinds[requests]}, job bigint")


def job_seed(job: Column, seed: int, recurrence: int, call: int, method: str) -> Column:
    """The first 8 bytes of a digest of all that tells jobs apart, below 2^63 - 1."""
    name = F.concat_ws(":", F.lit(f"{PROTOCOL}:{seed}:{recurrence}:{call}:{method}"), job.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint")
