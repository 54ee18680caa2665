"""Incremental cleaning of a stream of raw rows (an extension: the batch chain reruns instead)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import normal_url, url_base
from ..operators.cleaning import MAX_DISTANCE, _Base, cleaning_fold, not_yet, own_reason
from ..sources.catalog import Store
from ..sources.sinks import insert_if_absent


def clean_stream(stream: DataFrame, store: Store, checkpoint: str, table: str = "images_clean", seed: Callable[[DataFrame], DataFrame] = lambda done: done.where("cleaned")) -> StreamingQuery:
    """Folds each micro-batch after the rows accepted so far and appends its verdicts; a batch that is replayed adds nothing.

    Rows carry ``filename``, ``url``, ``downloaded``, ``width``, ``height``, ``gray_std``, ``phash`` and ``crawled_at``.
    """

    def add(batch: DataFrame, _: int) -> None:
        done = store.read(table) if store.exists(table) else None
        new = batch if done is None else not_yet(batch, done, "filename")
        insert_if_absent(store, table, cleaning_fold(new, None if done is None else seed(done)), "filename")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


#: Rows without a URL have no base; their verdict needs no state, and they are dealt to so many groups.
NO_BASE = 64
STATE = "urls array<string>, names array<string>, hashes array<string>"
VERDICT = "row string, reject_reason string"


def folded_by_base(stream: DataFrame, order: tuple[str, ...] = ("crawled_at", "filename"), distance: int = MAX_DISTANCE) -> DataFrame:
    """A stream of raw rows with ``cleaned`` and ``reject_reason``; what was accepted of each URL base is kept in the state store.

    A micro-batch touches the states of its own bases only, so its cost does not grow with what was cleaned before, and the states are those of the last
    finished batch after a restart.  Rows of one batch are folded in ``order``; batches follow each other.
    """
    # the row travels as one text, so that nulls and types come back as they were
    row = F.to_json(F.struct(*stream.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    base = url_base(F.col("url"))
    none = F.concat(F.lit("none "), F.pmod(F.xxhash64("filename"), F.lit(NO_BASE)).cast("string"))
    facts = stream.select(
        F.when(base == "", none).otherwise(F.concat(F.lit("base "), base)).alias("base"), normal_url(F.col("url")).alias("norm"), own_reason().alias("sound"), F.col("filename"),
        F.nullif(F.col("phash"), F.lit("")).alias("phash"), *[F.col(c).cast("string").alias(f"order_{i}") for i, c in enumerate(order)], row.alias("row"),
    )

    def fold(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([f"order_{i}" for i in range(len(order))], kind="stable", na_position="first")
        text = lambda v: v if isinstance(v, str) else None
        if key[0].startswith("none "):
            yield pd.DataFrame({"row": rows["row"], "reject_reason": "missing_url"})
            return
        held, urls, names, hashes = _Base(distance), [], [], []
        if state.exists:
            urls, names, hashes = (list(v) for v in state.get)
            held.urls |= set(urls)
            for name, phash in zip(names, hashes, strict=True):
                held.accept(None, phash, name)
        reasons = []
        for norm, sound, name, phash in zip(*(map(text, rows[c]) for c in ("norm", "sound", "filename", "phash")), strict=True):
            reason = "duplicate_url" if norm in held.urls else sound
            if reason is None and (near := held.near(phash)) is not None:
                reason = f"duplicate_phash_of_{near}"
            if reason is None:
                held.accept(norm, phash, name)
                urls.append(norm)
                if phash:
                    names.append(name)
                    hashes.append(phash)
            reasons.append(reason)
        state.update((urls, names, hashes))
        yield pd.DataFrame({"row": rows["row"].tolist(), "reject_reason": reasons})

    found = facts.groupBy("base").applyInPandasWithState(fold, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)
    back = found.select(F.from_json("row", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r"), "reject_reason")
    own = [c for c in stream.columns if c not in ("cleaned", "reject_reason")]
    return back.select(*[F.col("r").getField(c).alias(c) for c in own], "reject_reason", F.col("reject_reason").isNull().alias("cleaned"))


def clean_stream_by_base(stream: DataFrame, store: Store, checkpoint: str, table: str = "images_clean") -> StreamingQuery:
    """``folded_by_base`` into a table; a batch that is replayed adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        insert_if_absent(store, table, batch, "filename")

    return folded_by_base(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
