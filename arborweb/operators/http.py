"""Status classes of responses and what to do about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PERSISTENT, SOFT_FAILURE, SUCCESSFUL, TRANSIENT


def code_types(overrides: dict[int, str] | None = None) -> dict[int, str]:
    """Class by status code: the defaults with ``overrides`` in their place."""
    out = {c: kind for kind, codes in (("successful", SUCCESSFUL), ("transient", TRANSIENT), ("persistent", PERSISTENT)) for c in codes}
    bad = {*(overrides or {}).values()} - {"successful", "transient", "persistent"}
    if bad:
        raise ValueError(f"unknown status classes {sorted(bad)}")
    return out | (overrides or {})


def codes_of(kind: str, overrides: dict[int, str] | None = None) -> set[int]:
    return {c for c, k in code_types(overrides).items() if k == kind}


def classify(status: Column, overrides: dict[int, str] | None = None) -> Column:
    """successful, transient or persistent; an unknown or null code is persistent."""
    types = code_types(overrides)
    of = {k: sorted(c for c, x in types.items() if x == k) for k in ("successful", "transient")}
    return F.when(status.isin(*of["successful"]), "successful").when(status.isin(*of["transient"]), "transient").otherwise("persistent")


def code_table(spark: SparkSession, overrides: dict[int, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted(code_types(overrides).items()), "status_code INT, class STRING")


def is_transient(status: Column, overrides: dict[int, str] | None = None) -> Column:
    return classify(status, overrides) == "transient"


def is_persistent(status: Column, overrides: dict[int, str] | None = None) -> Column:
    return classify(status, overrides) == "persistent"


def effective_status(status: Column, really: Column) -> Column:
    """A successful answer that the caller's test finds to be none counts as a soft failure."""
    return F.when((classify(status) == "successful") & ~really, F.lit(SOFT_FAILURE)).otherwise(status)


def outcomes(responses: DataFrame, *, really: Callable[[DataFrame], Column] | None = None, passing: Callable[[DataFrame], Column] | None = None, retries: int = 3, overrides: dict[int, str] | None = None) -> DataFrame:
    """``responses`` with ``class`` and ``action``: step, retry (a transient status before the
    last of ``retries`` attempts), failed_probe (a speculative request) or error. Columns
    ``attempt`` and ``is_speculative`` are read if there. ``really`` tells by the whole
    response whether a successful one is, ``passing`` whether a failure will pass,
    whatever its status (or none): by a header or the body, say."""
    status = F.col("status_code")
    if really is not None:
        status = effective_status(status, really(responses))
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(1)
    probe = F.coalesce(F.col("is_speculative"), F.lit(False)) if "is_speculative" in responses.columns else F.lit(False)
    of = classify(status, overrides)
    if passing is not None:
        of = F.when((of == "persistent") & F.coalesce(passing(responses), F.lit(False)), "transient").otherwise(of)
    rows = responses.withColumn("class", of)
    return rows.withColumn(
        "action",
        F.when(F.col("class") == "successful", "step").when((F.col("class") == "transient") & (attempt < retries), "retry").when(probe, "failed_probe").otherwise("error"),
    )
