"""Exports. Each target has an encode step (a DataFrame) and a write step.

Write steps take a client factory that is called once per partition on the
executor, so any client library fits.
"""
