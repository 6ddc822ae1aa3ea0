"""Findings of several reviewing models: compared by model, and those that models agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.settings import ADDRESS, host_of
from ..plans.catalog import SEVERITIES

# fixed values: states of a review
STATUSES = ("ok", "unavailable", "timeout", "invalid-response", "skipped-offline", "not-run")


def _equals(value: str):
    return lambda found: found == value


def compare_models(reviews: DataFrame) -> DataFrame:
    """One row a model of ``reviews`` (model_name, status, findings: array of (file, category, severity)).

    Reviews by status and findings by severity, the most severe one and the most frequent status (the earlier of equals).
    """
    each = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES]
    severities = F.transform(F.coalesce("findings", F.array().cast(reviews.schema["findings"].dataType)), lambda f: f["severity"])
    rows = reviews.withColumn("severities", severities)
    found = [F.coalesce(F.sum(F.size(F.filter("severities", _equals(s)))), F.lit(0)).alias(s) for s in SEVERITIES]
    out = rows.groupBy("model_name").agg(*each, F.coalesce(F.sum(F.size("severities")), F.lit(0)).alias("findings"), *found)
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in SEVERITIES])
    most = F.greatest(*[s.replace("-", "_") for s in STATUSES])
    return out.withColumn("highest_severity", worst).withColumn("dominant_status", F.coalesce(*[F.when(F.col(s.replace("-", "_")) == most, F.lit(s)) for s in STATUSES]))


def consensus(reviews: DataFrame) -> DataFrame:
    """(name, file, category, severity, models) of findings that two or more models report; ``reviews`` also has name."""
    rows = reviews.filter("status = 'ok'").select("name", "model_name", F.explode("findings").alias("f"))
    rows = rows.select("name", "model_name", F.coalesce("f.file", F.lit("unknown file")).alias("file"), "f.category", "f.severity")
    out = rows.groupBy("name", "file", "category", "severity").agg(F.array_sort(F.collect_set("model_name")).alias("models"))
    return out.filter(F.size("models") > 1)


def file_budget(files: DataFrame, limit: int = 50) -> DataFrame:
    """The files of each target that a review may see: its entry file first, then by path (target_id, path, is_entry)."""
    w = Window.partitionBy("target_id").orderBy(F.desc("is_entry"), "path")
    return files.withColumn("nr", F.row_number().over(w)).filter(F.col("nr") <= limit)


def top_consensus(agreed: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` rows of ``consensus`` by severity, name, file and category: (nr, text, more), ``more`` being how many are not shown."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    place = F.when(F.col("file") == "unknown file", F.col("name")).otherwise(F.concat_ws("/", "name", "file"))
    text = F.concat(place, F.lit(" "), F.col("severity"), F.lit(" ("), F.size("models").cast("string"), F.lit(" models)"))
    more = agreed.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("more"))
    shown = agreed.withColumns({"severity_rank": rank, "text": text}).orderBy("severity_rank", "name", "file", "category").limit(top)
    w = Window.orderBy("severity_rank", "name", "file", "category")  # of the rows shown
    return shown.withColumn("nr", F.row_number().over(w)).join(F.broadcast(more)).select("nr", "text", "more")


def select_models(registry: DataFrame, *wanted: str) -> list[Row]:
    """The rows of the registry (name, disabled, context_tokens) that are asked for, by name; a registry is small.

    Names may be repeated and joined by commas; ``all`` alone stands for every model that is enabled.
    """
    names = list(dict.fromkeys(n.strip() for w in wanted for n in w.split(",") if n.strip()))
    if not names:
        raise ValueError("name a model")
    known = {r.name: r for r in registry.orderBy("name").collect()}
    if names == ["all"]:
        names = [n for n, r in known.items() if not r.disabled]
    for n in names:
        if n not in known or known[n].disabled:
            raise ValueError(f"model {n!r} is {'disabled' if n in known else 'not known'}")
    if not names:
        raise ValueError("no model is enabled")
    return [known[n] for n in sorted(names)]


def smallest_context(models: list[Row], default: int = 2048) -> int:
    """The fewest tokens that any of the models takes in."""
    return min((m.context_tokens or default for m in models), default=default)


def loopback_url(url: str) -> str:
    """The address without closing slashes, if it is a web address of this machine without credentials."""
    host = host_of(url)
    if host is None:
        raise ValueError("not a web address")
    if "@" in ADDRESS.match(url.strip())[2]:
        raise ValueError("an address must not hold credentials")
    if host not in ("localhost", "::1") and not host.startswith("127."):
        raise ValueError("an address must be of this machine")
    return url.strip().rstrip("/")
