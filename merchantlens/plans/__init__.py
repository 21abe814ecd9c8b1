"""Whole jobs put together from operators: load, explore, forecast, dashboard."""
