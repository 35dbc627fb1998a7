"""The container format: bytes to dataclasses and back."""
