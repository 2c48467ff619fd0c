"""What both jobs share: config files, logging, the session of a command line."""

from __future__ import annotations

import dataclasses
import json
import logging
import typing

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str | None, kind: type):
    """A ``kind`` of the JSON object at ``path``, in any store Spark can reach; defaults without a path.

    Unknown keys and values of the wrong type raise ``ValueError`` before any data is read.
    """
    if path is None:
        return kind()
    values = json.loads(spark.read.text(path, wholetext=True).first()[0])
    hints = typing.get_type_hints(kind)
    unknown = sorted(set(values) - set(hints))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    for name, value in values.items():
        if isinstance(value, list):
            values[name] = value = tuple(value)
        shape = typing.get_origin(hints[name]) or hints[name]
        if not isinstance(value, shape) or (isinstance(value, bool) and shape is not bool):
            raise ValueError(f"{path}: {name} must be {shape.__name__}")
    return kind(**values)


def set_up_logging(level: str) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s")


def as_json(config) -> str:
    """A config as its file would have it, for the log."""
    return json.dumps(dataclasses.asdict(config), sort_keys=True)
