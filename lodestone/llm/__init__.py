"""Operators of a training-data pipeline: counting, labelling, deduplicating, scanning, mixing and packing texts."""
