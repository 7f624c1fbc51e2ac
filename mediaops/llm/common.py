"""What the operators share: Arrow passes that carry other columns along, word bytes, stored steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in pieces of about so many bytes, so that one text never needs much more than itself.
PIECE = 1 << 22


def add_columns(df: DataFrame, inputs: list[str], outputs: str, fn: Callable) -> DataFrame:
    """Adds columns that ``fn(*arrow arrays) -> list of arrow arrays`` computes batch by batch.

    ``outputs`` is a DDL list. Other columns pass through untouched; a column of ``df`` that has the name of
    an output is replaced.
    """
    new = T.StructType.fromDDL(outputs)
    taken = {name.lower() for name in new.fieldNames()}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    sent = kept + [f for f in df.schema.fields if f.name.lower() in taken and f.name in inputs]
    places = [[f.name for f in sent].index(name) for name in inputs]
    n_kept, names = len(kept), [f.name for f in kept] + new.fieldNames()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = fn(*(batch.column(i) for i in places))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_kept)] + made, names=names)

    return df.select([F.col(f"`{f.name}`") for f in sent]).mapInArrow(run, T.StructType(kept + list(new.fields)))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def word_pieces(data: bytes):
    """Lists of the words of a text, piece by piece. No word is cut."""
    from re import compile as rx

    if len(data) <= PIECE:
        yield data.split()
        return
    gap, at = rx(rb"[\x20\x09-\x0d]"), 0
    while at < len(data):
        hit = gap.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = hit.start() if hit else len(data)
        yield data[at:end].split()
        at = end


def shielded(df: DataFrame, names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns called ``names`` (blank-separated) renamed, and what brings all its columns, under
    their own names and without others, back after a pass that adds columns of those names."""
    taken = set(names.split())
    moved = {c: f"__own_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    back = [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]
    return df.withColumnsRenamed(moved) if moved else df, lambda out: out.select(back)
