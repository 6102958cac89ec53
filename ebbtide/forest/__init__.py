"""Forests of trees that are grown until their leaves are pure."""
