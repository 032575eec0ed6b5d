"""Named steps and their usual order: each takes and returns (path, content) books."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, transforms
from ..operators import tokens as tk
from ..sinks import reports

Step = Callable[[DataFrame], DataFrame]
# What usually follows what. Containers are only made of verified books.
NEXT = {"ingest": "verify", "verify": "cleanup", "cleanup": "paragraphs", "paragraphs": "manifest", "container": "verify"}


@dataclass(frozen=True)
class Pipeline:
    """Steps in order; run() hands each one's result to the next."""

    steps: tuple[tuple[str, Step], ...]

    def run(self, books: DataFrame) -> DataFrame:
        for _, step in self.steps:
            books = step(books)
        return books

    def then(self, name: str, step: Step) -> Pipeline:
        return Pipeline((*self.steps, (name, step)))


def rewrite(books: DataFrame, step: Step, out: str, most: int | None = None) -> DataFrame:
    """Write the books (path, name, content) that a step changes below ``out``, in ``changed``, and in ``original`` as they were.

    At most so many, first by path, if that is asked for. Returns (path, name) of those; the input stays as it is, and
    original holds what brings them back (see transforms.revert).
    """
    changed = transforms.changed_only(books, step(books), most).select("path", "content")
    names = books.select("path", F.col("name").alias("file_name"))
    reports.write_books(changed.join(names, "path"), f"{out}/changed")
    reports.write_books(transforms.revert(changed, books).select("path", "content").join(names, "path"), f"{out}/original")
    return changed.join(names, "path").select("path", F.col("file_name").alias("name"))


def next_step(name: str) -> str | None:
    return NEXT.get(name)


def interlocked(options: dict, language: str = "en") -> dict:
    """Options that imply or exclude others, brought into line."""
    o = dict(options)
    if language not in ("en",) and not language.isascii():
        o["ascii_text"] = True
    if o.get("all_quotes"):
        o["double_quotes"] = True
    if o.get("remove_s5"):
        o["s5_only"] = False
    if not o.get("label"):
        o["label"] = None
    return o


def cleanup(**options) -> Step:
    return lambda books: transforms.clean_books(books, **options).select("path", "content")


def paragraphs(model: DataFrame, **options) -> Step:
    """Marks by the books of a model folder (path, content)."""
    marks = transforms.paragraph_model(tk.with_context(tk.tokens(model.select("path", "content"))))
    return lambda books: transforms.mark_paragraphs(tk.with_context(tk.tokens(books.select("path", "content"))), marks, **options).select("path", "content")


def verified(books: DataFrame, dims_books: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Issues of books and their summary."""
    found = checks.verify(books, dims_books, **options)
    return found, checks.summary(found)
