"""Lodestone operators."""
