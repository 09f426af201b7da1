"""Binned-count analytics on Spark DataFrames."""

from .schema import ChainSettings, ModelSettings, Variables, select_model_columns

__all__ = ["ChainSettings", "ModelSettings", "Variables", "select_model_columns"]
