"""Stored tables: upsert, append with ids, update, lists, counts, references, usage, budget and the hash-chained log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .order import numbered, running_sum


def upsert(rows: DataFrame, key: list[str], seq: Column) -> DataFrame:
    """The last row of each key. max_by is pre-aggregated: a hot key is no hot task."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), seq).alias("_r")).select(*key, "_r.*")


def append(table: DataFrame, rows: DataFrame, order: str, name: str = "id") -> DataFrame:
    """table with rows behind it, numbered on from its largest id by the numeric column `order`, which goes."""
    last = table.agg(F.coalesce(F.max(name), F.lit(0)).alias("last")).first()["last"]
    new = numbered(rows, order, "_place").withColumn(name, F.col("_place") + last).select(table.columns)
    return table.unionByName(new)


def update(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str], seq: str | None = None) -> DataFrame:
    """rows with the values of changes where they are not null. Of several changes for a key the last by seq counts.

    Without seq the largest value of each column counts, so that no row is ever doubled. A null key matches nothing.
    """
    pick = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))) if seq else F.max
    new = changes.groupBy(*key).agg(*[pick(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(rows.columns)


def listed(table: DataFrame, newest: str | None = None, **conditions) -> DataFrame:
    """Rows that meet every condition whose value is not None; newest first if a column is named."""
    for column, value in conditions.items():
        table = table.where(F.col(column) == value) if value is not None else table
    return table.orderBy(F.col(newest).desc_nulls_last(), *[c for c in table.columns if c.endswith("id")]) if newest else table


def recent(table: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n newest rows; rows of one time by their other columns."""
    return table.orderBy(F.col(by).desc_nulls_last(), *[c for c in table.columns if c != by]).limit(n)


def dangling(rows: DataFrame, parents: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")


def stats(hooks: DataFrame, findings: DataFrame, tasks: DataFrame, events: DataFrame) -> DataFrame:
    """One row of seven counts. Each table is counted in one pass, its filtered counts with it."""
    n = lambda rows, **counts: rows.agg(*[c.alias(name) for name, c in counts.items()])
    some = lambda column, value: F.count_if(F.col(column) == value)
    of_hooks = n(hooks, hooks_total=F.count("*"), hooks_pending=some("status", "pending"))
    of_findings = n(findings, findings_total=F.count("*"), findings_true_positive=some("verdict", "true_positive"))
    of_tasks = n(tasks, tasks_queued=some("status", "queued"), tasks_running=some("status", "running"))
    rows = of_hooks.crossJoin(of_findings).crossJoin(of_tasks).crossJoin(n(events, events_logged=F.count("*")))  # one row each
    return rows


def counts(**tables: DataFrame) -> DataFrame:
    """name, n: the rows of each table."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def usage(tokens: DataFrame) -> DataFrame:
    """Totals of each agent; order them by total_prompt, largest first, where they are shown."""
    return tokens.groupBy("agent").agg(F.sum("prompt").alias("total_prompt"), F.sum("completion").alias("total_completion"))


def budget_share(tokens: DataFrame, budget: int) -> DataFrame:
    """One row: all tokens, and what percentage of the budget they are."""
    total = F.coalesce(F.sum(F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0))), F.lit(0))
    return tokens.agg(total.alias("total_tokens")).withColumn("pct", F.col("total_tokens") / budget * 100)


def budget_gate(calls: DataFrame, owner: str | None, order: str, cost: Column, budget: int, share: float = 0.9) -> DataFrame:
    """Running spend before a call, of each owner or (None) of all, and whether the call is refused."""
    spent = running_sum(calls, order, cost, "spent_before", [owner] if owner else [])
    return spent.withColumn("refused", F.col("spent_before") >= int(budget * share))


GENESIS = "0" * 64


def link(before: str, action: str | None, entity: str | None, ts: str | None) -> str:
    """The hash of an event that follows the one with the hash `before`."""
    return hashlib.sha256(f"{before}|{action or ''}|{entity or ''}|{ts or ''}".encode()).hexdigest()


def event_digest(*columns: str) -> Column:
    """What decides between events of one owner that share a seq."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def hash_chain(events: DataFrame, owner: str, keep: list[str] | None = None) -> DataFrame:
    """events (owner, seq, action, entity, ts text): owner, seq, columns to keep, hash of each, in a chain of each owner from 64 zeros on.

    Events are taken by seq, null first; those that share it by a digest of action, entity and time, so the order of input never
    matters. A chain is one sequence by its nature, but no more of it than a batch is held at once: rows come sorted, and
    the last hash is carried along. A null owner has a chain too. Nulls count as empty texts.
    """
    kept = [owner, "seq", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, started = None, GENESIS, False
        for batch in batches:
            hashes = []
            for who, action, entity, ts in zip(*(batch.column(c).to_pylist() for c in (owner, "action", "entity", "ts"))):
                if who != current or not started:
                    current, last, started = who, GENESIS, True
                last = link(last, action, entity, ts)
                hashes.append(last)
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(hashes, pa.string())], [*kept, "_hash"])

    rows = events.select(*dict.fromkeys([*kept, "action", "entity", "ts"])).withColumn("_digest", event_digest("action", "entity", "ts"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([rows.schema[c] for c in kept] + [StructField("_hash", StringType())])
    chained = rows.repartition(n, owner).sortWithinPartitions(owner, "seq", "_digest").mapInArrow(run, schema)
    return chained if "hash" in kept else chained.withColumnRenamed("_hash", "hash")


def chain_ends(chained: DataFrame, owner: str) -> DataFrame:
    """Length and last hash of each owner's chain."""
    return chained.groupBy(owner).agg(F.count("*").alias("n_events"), F.max_by("hash", "seq").alias("last_hash"))


def broken_links(stored: DataFrame, owner: str) -> DataFrame:
    """stored (owner, seq, action, entity, ts, hash): events whose hash is not what the chain gives. One pass, no join."""
    return hash_chain(stored, owner, [c for c in stored.columns if c not in (owner, "seq")]).where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(stored.columns)
