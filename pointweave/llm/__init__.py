"""Operators of a training-data pipeline over ``documents`` and ``conversations``; nothing else in the library imports them."""
