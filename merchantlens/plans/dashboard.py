"""Dashboard job: every table one selection asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantlens.functions import rules
from merchantlens.functions.dates import Period
from merchantlens.operators import filters as flt, forecast, insights, kpis, segments
from merchantlens.operators.filters import Filters
from merchantlens.session import cut_lineage


def options(merchants: DataFrame, category: str | None = None) -> dict[str, DataFrame]:
    """The lists a selection is made from."""
    names = (
        flt.merchant_names(merchants)
        if category is None
        else flt.merchants_of(merchants, category)
    )
    return {"categories": flt.categories(merchants), "merchants": names}


def selection(daily: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """The merchant-days of a selection and of the period before, read once and written."""
    kept = flt.date_range(daily, Period(chosen.period.previous().start, chosen.period.end))
    if chosen.category is not None or chosen.merchant is not None:
        ids = chosen.chosen(merchants).select("merchant_id")
        kept = kept.join(ids, "merchant_id", "left_semi")
    return cut_lineage(kept)


def dashboard(
    daily: DataFrame,
    txns: DataFrame,
    merchants: DataFrame,
    chosen: Filters,
    forecasts: DataFrame | None = None,
    importance: DataFrame | None = None,
    horizon: int = rules.HORIZON,
) -> dict[str, DataFrame]:
    """Tables by name; forecasts are shown for the unfiltered platform only.

    The selection and the comparison, which several tables need, are computed at once and
    stored; the tables themselves are lazy.
    """
    daily = selection(daily, merchants, chosen)
    compared = cut_lineage(kpis.period_compare(daily, merchants, chosen))
    series = kpis.revenue_series(daily, merchants, chosen)
    tables = {
        "report": kpis.report_rows(daily, merchants, chosen),
        "comparison": compared,
        "cards": kpis.cards(compared),
        "revenue": series.orderBy("agg_date"),
        "segments": segments.top_segments(daily, merchants, chosen),
        "payment_mix": segments.payment_mix(txns, chosen.period),
    }
    if forecasts is not None and chosen.category is None and chosen.merchant is None:
        platform = forecasts.where(forecasts.forecast_level == "Platform")
        shown = forecast.window(platform, chosen.period, horizon)
        tables["revenue"] = forecast.overlay(series, shown).orderBy("day", "kind")
    if importance is not None:
        tables["drivers"] = forecast.label_features(importance)
    return tables


def ask(
    questions: DataFrame,
    daily: DataFrame,
    txns: DataFrame,
    merchants: DataFrame,
    chosen: Filters,
    horizon: int = rules.HORIZON,
) -> DataFrame:
    """Answers to a table of questions (``text``) about a selection."""
    headline = kpis.headline(daily, merchants, chosen)
    top = insights.top_method(segments.payment_mix(txns, chosen.period))
    return insights.answers(insights.route(questions), headline, top, horizon)
