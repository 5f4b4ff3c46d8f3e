"""Scalar building blocks: pattern dialects, exact rounding, text helpers."""
