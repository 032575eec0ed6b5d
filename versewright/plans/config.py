"""Options from INI files: a section gives values to the fields of a dataclass, which has the defaults."""

from __future__ import annotations

from configparser import ConfigParser
from dataclasses import fields
from io import StringIO
from typing import TypeVar

from pyspark.sql import SparkSession

Settings = TypeVar("Settings")
WORDS = {word: True for word in ("yes", "true", "on", "1")} | {word: False for word in ("no", "false", "off", "0")}


def read(spark: SparkSession, path: str) -> str:
    """The text of a file wherever Spark can read it; a configuration is small."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def value(text: str, like: object) -> object:
    """A text as a value of the same kind as a default: a truth, a number, names apart by commas, or the text, empty for none."""
    if isinstance(like, bool):
        word = text.strip().lower()
        if word not in WORDS:
            raise ValueError(f"neither yes nor no: {text!r}")
        return WORDS[word]
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, (tuple, frozenset, list)):
        return type(like)(name.strip() for name in text.split(",") if name.strip())
    return text if text or like is not None else None


def settings(kind: type[Settings], text: str, section: str) -> Settings:
    """An object of a dataclass with what a section of an INI text says; what it doesn't say, or no such section, is as by default.

    A name that the dataclass doesn't know is an error, as it would be a setting without effect.
    """
    parser = ConfigParser(interpolation=None)
    parser.read_string(text)
    given, default = dict(parser[section]) if parser.has_section(section) else {}, kind()
    if unknown := given.keys() - {f.name for f in fields(kind)}:
        raise ValueError(f"[{section}] has no setting {', '.join(sorted(unknown))}")
    return kind(**{name: value(t, getattr(default, name)) for name, t in given.items()})


def written(settings_: object, section: str) -> str:
    """An INI section that settings() reads back."""
    parser, out = ConfigParser(interpolation=None), StringIO()
    shown = lambda v: "" if v is None else ", ".join(sorted(v)) if isinstance(v, frozenset) else ", ".join(v) if isinstance(v, (tuple, list)) else str(v)
    parser[section] = {f.name: shown(getattr(settings_, f.name)) for f in fields(settings_)}
    parser.write(out)
    return out.getvalue()
