"""Steps put together into whole jobs."""
