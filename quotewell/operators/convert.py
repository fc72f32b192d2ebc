"""Valuation of a timeline in a target currency by strict as-of reference prices along currency paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import divide_doubles
from ..plans.paths import Edge, graph, paths
from ..schema import FAILURE, STATUS
from .asof import aged, strict_asof


def _priced(rows: DataFrame, edges: list[Edge], time: Column, max_age_ns: int, price: str, field: str, infinite: bool) -> DataFrame:
    """Adds each edge's step and failure as columns, so that they are computed once however many paths and results use them."""
    divide = divide_doubles if infinite else F.try_divide
    aged_by = {e: aged(F.col(f"ref_{e.stream_id}"), time, max_age_ns, price, field) for e in edges}
    rows = rows.withColumns({_name("price", e): value for e, (value, _) in aged_by.items()})
    rows = rows.withColumns({_name("step", e): divide(F.lit(1.0), F.col(_name("price", e))) if e.inverse else F.col(_name("price", e)) for e in edges})
    # a step divided as doubles is null where its price is
    null = {e: F.col(_name("price" if infinite else "step", e)).isNull() for e in edges}
    return rows.withColumns({_name("failed", e): F.coalesce(failed, F.when(null[e], "arithmetic")) for e, (_, failed) in aged_by.items()})


def _name(kind: str, e: Edge) -> str:
    return f"__{kind}_{e.stream_id}_{e.inverse}"


def _path_rate(path: tuple[Edge, ...]) -> tuple[Column, Column]:
    """(rate, failure) of a path: the product over its edges, or the failure of its first edge that fails, whose step is null."""
    rate, failure = F.lit(1.0), F.lit(None).cast("string")
    for e in path:
        rate, failure = rate * F.col(_name("step", e)), F.coalesce(failure, F.col(_name("failed", e)))
    return rate, failure


def convert(
    timeline: DataFrame,
    instruments: list[tuple[str, str, str]],
    quotes: dict[str, str],
    target: str,
    price: str,
    order: list[str],
    max_age_ns: int,
    width_ns: int,
    stream: str = "stream_id",
    max_hops: int = 3,
    primary_only: bool = False,
    by_time: bool = False,
    skip: Column | None = None,
    infinite: bool = False,
) -> DataFrame:
    """Adds conversion_status, conversion_failure, conversion_rate, conversion_path and price_target.

    ``quotes`` names the quote currency of each stream. Of a stream's paths the first that has fresh references gives the rate; if
    none has, the failure is that of the last path tried. References of a row are strictly earlier, so no trade values itself.
    The inverse of a price of zero fails as arithmetic, or with ``infinite`` is an infinite rate.
    """
    edges = graph(instruments)
    plans = {s: paths(edges, q, target, max_hops)[: 1 if primary_only else None] for s, q in quotes.items()}
    needed = sorted({e.stream_id for ps in plans.values() for p in ps for e in p})
    rows = strict_asof(timeline, {f"ref_{s}": F.col(stream) == s for s in needed}, price, order, width_ns, by_time) if needed else timeline
    tried_edges = list({(e.stream_id, e.inverse): e for ps in plans.values() for p in ps for e in p}.values())
    rows = _priced(rows, tried_edges, F.col(order[0]), max_age_ns, price, order[0], infinite) if needed else rows
    rate, failure, path = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for s, ps in sorted(plans.items()):
        own = F.col(stream) == s
        tried = [(*_path_rate(p), F.array(F.lit(quotes[s]), *[F.lit(e.to) for e in p])) for p in ps]
        first = F.coalesce(*[r for r, _, _ in tried]) if tried else F.lit(None).cast("double")
        last = tried[-1][1] if tried else F.lit("no_path")
        chosen = F.coalesce(*[F.when(r.isNotNull(), n) for r, _, n in tried]) if tried else F.lit(None).cast("array<string>")
        rate = F.when(own, first).otherwise(rate)
        failure = F.when(own & first.isNull(), last).otherwise(failure)
        path = F.when(own, chosen).otherwise(path)
    rows = rows.withColumns({"__rate": rate, "__failure": failure})
    rate, failure = F.col("__rate"), F.col("__failure")
    identity = F.col(stream).isin([s for s, q in quotes.items() if q == target])
    status = F.when(skip if skip is not None else F.lit(False), "skipped").when(identity, "identity").when(rate.isNotNull(), "converted").otherwise("unavailable")
    used = F.col("conversion_status").isin("identity", "converted")
    out = rows.withColumn("conversion_status", status)
    out = out.withColumn("conversion_rate", F.when(used, rate)).withColumn("conversion_failure", F.when(F.col("conversion_status") == "unavailable", F.coalesce(failure, F.lit("no_path")))).withColumn("conversion_path", F.when(used, path))
    return out.withColumn("price_target", F.col(price) * F.col("conversion_rate")).drop("__rate", "__failure", *[f"ref_{s}" for s in needed], *[_name(k, e) for k in ("price", "step", "failed") for e in tried_edges])


def coded(df: DataFrame) -> DataFrame:
    """Status and failure as their stored codes."""
    pick = lambda c, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c)).cast("short")
    return df.withColumn("conversion_status", pick("conversion_status", STATUS)).withColumn("conversion_failure", F.when(F.col("conversion_failure").isNotNull(), pick("conversion_failure", FAILURE)))


def accounting(converted: DataFrame, by: list[str] | None = None) -> DataFrame:
    return converted.groupBy(*(by or []), "conversion_status", "conversion_failure").agg(F.count(F.lit(1)).alias("events"))


def invalid_rows(converted: DataFrame, price: str) -> DataFrame:
    """Rows that break what their status promises."""
    s = F.col("conversion_status")
    ok = F.when(s == "identity", (F.col("conversion_rate") == 1) & (F.col("price_target") == F.col(price))).when(s == "converted", F.col("conversion_rate").isNotNull() & F.col("conversion_failure").isNull()).when(s == "unavailable", F.col("conversion_failure").isNotNull() & F.col("price_target").isNull()).otherwise(F.col("price_target").isNull())
    return converted.where(~F.coalesce(ok, F.lit(False)))
