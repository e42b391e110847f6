"""Scalar building blocks: time, intervals, JSON documents."""
