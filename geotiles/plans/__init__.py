"""Rewriting of map boxes into code ranges, and the layouts that make them cheap."""
