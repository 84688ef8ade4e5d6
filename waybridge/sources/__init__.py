"""Readers that turn raw records, grids and reference lists into tables."""
