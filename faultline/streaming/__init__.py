"""Stateless text and feature functions applied to streaming DataFrames."""
