"""FUNCSIG rows from keyword arguments."""

from driftlens.operators.prepare import prepared
from driftlens.schema import FUNCSIG
from driftlens.sources.extract import _row


def sigs(spark, *rows, **common):
    full = []
    for r in rows:
        r = common | r
        r.setdefault("qualname", r.get("name", ""))
        full.append(tuple(_row(**r)[f.name] for f in FUNCSIG))
    return prepared(spark.createDataFrame(full, FUNCSIG))
