"""Continuous decoding of arriving archives."""
