"""A line-oriented shell over a store: init a b, put k v, del k, get k, scan [lo hi], flush, compact, dump, quit, close."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from .model import Bound
from .sources.store import Store


def generate(store: Store, a: int, b: int, epoch: int):
    """Keys a..b with values value<i>@<epoch>, as rows of a batch."""
    i = F.col("id").cast("string")
    return store.spark.range(a, b + 1).select(i.cast("binary").alias("key"), F.col("id").alias("seq"), F.concat(F.lit("value"), i, F.lit(f"@{epoch}")).cast("binary").alias("value"))


def execute(store: Store, line: str, epoch: int) -> Iterator[str]:
    """Output lines of one command; raises ValueError on what it doesn't know."""
    word, *args = line.split() or [""]
    word = word.lower()
    if word == "init" and len(args) >= 2:
        store.commit_rows(generate(store, int(args[0]), int(args[1]), epoch))
        yield f"{max(0, int(args[1]) - int(args[0]) + 1)} values filled with epoch {epoch}"
    elif word == "put" and len(args) >= 2:
        store.put(args[0].encode(), args[1].encode())
    elif word == "del" and args:
        store.delete(args[0].encode())
    elif word == "get" and args:
        v = store.get(args[0].encode())
        yield f"{args[0]} not exist" if v is None else f"{args[0]}={v.decode(errors='replace')}"
    elif word == "scan" and len(args) != 1:
        lo, hi = (Bound(args[0].encode()), Bound(args[1].encode())) if args else (None, None)
        n = 0
        for r in store.scan(lo, hi).toLocalIterator():
            n += 1
            yield f"{bytes(r.key).decode(errors='replace')}={bytes(r.value).decode(errors='replace')}"
        yield f"{n} keys scanned"
    elif word == "flush":
        store.flush()
    elif word == "compact":
        store.compact()
    elif word == "dump":
        for r in store.dump().collect():
            yield f"L{r.level} ({r.files}): {r.ids}"
    else:
        raise ValueError(f"not a command: {line!r}")


def run(store: Store, lines: Iterable[str] = sys.stdin, out=print) -> None:
    epoch = 0
    for line in lines:
        if line.strip().lower() in ("quit", "close"):
            break
        try:
            for x in execute(store, line, epoch):
                out(x)
            epoch += 1
        except ValueError as e:
            out(f"error: {e}")
    store.close()
