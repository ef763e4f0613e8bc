"""Rows that stay whole while an operator works beside them.

Documents travel as one struct (``row``), so that no column name of theirs can clash with an operator's
own columns; what an operator adds gets a name that is still free.  A row is known by its id and by
the hash of its text (``version``), which keeps rows apart that share an id or have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_of(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def held(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, version)."""
    return docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc"), version_of(text_col).alias("version"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose (doc_id, version) is in ``gone``."""
    rows, out = held(docs, id_col, text_col), gone.select(F.col("doc_id").alias("gone_doc"), F.col("version").alias("gone_version")).distinct()
    same = F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("version") == F.col("gone_version"))
    return rows.join(out, same, "left_anti").select("row.*")


def free(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind as it takes to be no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
