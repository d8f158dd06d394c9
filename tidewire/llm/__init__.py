"""Operators for preparing large text corpora; nothing else in tidewire imports this package."""
