"""Idempotent Parquet table store: all-or-nothing batches, versions, updates by row.

Layout under ``root`` (a shared folder, e.g. under ``spark.checkpoint.dir``)::

    <table>/writer=<w>/batch_id=<n>/run=<r>/part-*.parquet            rows that batch n of writer w added
    _erased/<table>/writer=<w>/batch_id=<n>/run=<r>/part-*.parquet    (path, row) of rows that a batch replaced
    _index/<table>/writer=<w>/batch_id=<n>/run=<r>/part-*.parquet     what the files of that run may hold, key filters too
    _log/writer=<w>/batch_id=<n>/part-*.parquet                       one file: what the batch did, written last
    _schemas/<table>                                                  the table's schema as JSON
    _work/run=<r>/<n>/part-*.parquet                                  rows that a batch being written reads more than once,
                                                                      until its last reader has read them

Files are never changed. A batch becomes visible by its log file, which lists the files
it added with what they may hold (:mod:`assaykit.plans.fileindex`; the key filters stay in
``_index``, which the tasks that read the new files write), the files it took
away, and the files of replaced rows. A version of a table is the files that the log up to
a moment leaves; readers that hold a version keep it, whatever later batches, replays or
purges do, until :meth:`TableStore.vacuum` clears the folders that no newer version uses. A
batch that is already in the log is skipped, so a retried ``foreachBatch`` call changes
nothing; what a failed attempt left behind is in no log and so never seen. Batches belong
to a named writer, so jobs that share a store (normalizer, consumers, sweep, purge) never
meet on a batch id. A new checkpoint counts from 0 again and so needs a new writer name.

Inserts follow ``ON CONFLICT DO NOTHING``: the first row per key inside the batch, then
rows whose key is already stored are dropped. Null key parts equal each other. The stored
files are asked by their key filters first, so a micro-batch opens only the files that may
hold one of its keys; batches of more than ``fileindex.LOOKUP_HASHES`` keys are joined
with the key columns of all files. Two writers that insert one key at the same moment both
keep it: give the inserts of a table to one job at a time.

Rows are laid out by day, provider and key, so that a file covers few days and providers
where there are many rows; reads by time, provider, kind or id open only the files that may
hold such rows, and Parquet's own statistics do the rest.

Outbox state changes are appended as events (``outbox_state``); the current state of a row
is its latest event.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from assaykit.functions import pii
from assaykit.operators.aggregates import first_wins
from assaykit.plans import fileindex as X
from assaykit.plans import pipeline as P
from assaykit.session import written_parquet

#: Key of each table, the columns that reads filter by, and the time its rows expire by.
TABLES = {
    "assessments": ["id"],
    "normalization_audit_log": ["assessment_id"],
    "outbox": ["assessment_id"],
    "failed_records": ["input_hash", "provider"],
    "schema_violations": ["boundary", "provider", "input_hash"],
}
FACETS = {
    "assessments": ["source_provider"],
    "normalization_audit_log": ["provider"],
    "failed_records": ["provider", "error_kind", "replayed"],
    "schema_violations": ["provider", "boundary"],
}
#: Columns whose hashes the files of a table are asked for.
LOOKUP = TABLES | {"outbox_state": ["assessment_id"]}
TIME, ID = "created_at", "id"
#: Rows of one file at most; bounds what summaries and filters of a file hold in a task.
FILE_ROWS = 1_000_000
LOG, SCHEMAS, ERASED, INDEX, WORK = "_log", "_schemas", "_erased", "_index", "_work"
WRITER, PART = "writer", "batch_id"
LOG_SCHEMA = f"seq bigint, tbl string, kind string, {X.FACTS}, filters string"
FILE, ROW = "_file", "_row"


def moment(at: dt.datetime) -> Column:
    """A UTC wall-clock time as a column, whatever the session's zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _matching(rows: DataFrame, where: dict[str, object]) -> DataFrame:
    for name, value in where.items():
        rows = rows.filter(F.col(TIME) >= moment(value) if name == "since" else F.col(TIME) < moment(value)
                           if name == "before" else F.col(name) == F.lit(value))
    return rows


class TableStore:
    def __init__(self, spark: SparkSession, root: str, writer: str = "main"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.writer = writer
        self._folders: dict[str, str] = {}
        self._done: list[DataFrame] = []
        self._dealt: set[str] = set()
        self._work: str | None = None
        self._held = 0
        self._schemas: dict[str, StructType] = {}

    def as_writer(self, writer: str) -> TableStore:
        """The same store, written under another writer's name."""
        return TableStore(self.spark, self.root, writer)

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    # -- versions ------------------------------------------------------------
    def log(self, version: int | None = None) -> DataFrame | None:
        """What the batches did, up to a version; None without a batch."""
        try:
            log = self.spark.read.schema(f"{LOG_SCHEMA}, {WRITER} string, {PART} bigint").parquet(self.path(LOG))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return log if version is None else log.filter(F.col("seq") <= version)

    def version(self) -> int | None:
        """The newest version; reads that are given it see the tables as they are now."""
        log = self.log()
        return None if log is None else log.agg(F.max("seq")).first()[0]

    def files(self, table: str, version: int | None = None, **may: object) -> DataFrame | None:
        """The files of a table with what they may hold; ``may``: see :meth:`read`."""
        log = self.log(version)
        if log is None:
            return None
        of = log.filter(F.col("tbl") == table)
        live = of.filter("kind = 'rows'").join(of.filter("kind = 'gone'").select("path"), "path", "left_anti")
        for name, value in may.items():
            if name == "since":
                live = live.filter(F.col("last_at").isNull() | (F.col("last_at") >= moment(value)))
            elif name == "before":
                live = live.filter(F.col("first_at").isNull() | (F.col("first_at") < moment(value)))
            elif name == "id":
                live = live.filter(F.col("low_id").isNull() | F.lit(value).between(F.col("low_id"), F.col("high_id")))
            else:
                live = live.filter(X.facet_may_be(name, value))
        if "id" in may:
            one = self.spark.range(1).select(X.id_hash(F.lit(may["id"]))).first()[0]
            live = live.join(X.may_hold(self._filters(live), np.array([one])), "path", "left_semi")
        return live

    def _filters(self, files: DataFrame) -> DataFrame:
        """(path, key_filter) of some files of the log, from the index folders of the batches that wrote them."""
        folders = [r[0] for r in files.select("filters").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], "path string, key_filter binary")
        kept = self.spark.read.schema("path string, key_filter binary").parquet(*folders)
        return kept.join(files.select("path").distinct(), "path", "left_semi")

    def _schema(self, table: str) -> StructType | None:
        if table in self._schemas:      # it never changes
            return self._schemas[table]
        try:
            kept = self.spark.read.text(self.path(f"{SCHEMAS}/{table}"), wholetext=True).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        self._schemas[table] = StructType.fromJson(json.loads(kept[0]))
        return self._schemas[table]

    # -- reading -------------------------------------------------------------
    def read_files(self, table: str, paths: Iterable[str], version: int | None = None,
                   located: bool = False) -> DataFrame:
        """The rows of some files of a table without those replaced since; ``located`` adds each row's file and place."""
        schema, paths = self._schema(table), sorted(set(paths))
        extra = f"{FILE} string, {ROW} bigint"
        if not paths:
            empty = self.spark.createDataFrame([], schema)
            return empty.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in extra.split(", ")]) \
                if located else empty
        rows = self.spark.read.schema(schema).parquet(*paths)
        erased = [r[0] for r in self.log(version).filter((F.col("tbl") == table) & (F.col("kind") == "erased"))
                  .select("path").distinct().collect()]
        if not erased and not located:
            return rows
        rows = rows.select(*schema.names, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        if erased:
            gone = self.spark.read.schema(extra).parquet(*erased)
            rows = rows.join(gone, [FILE, ROW], "left_anti")
        return rows if located else rows.select(*schema.names)

    def read(self, table: str, version: int | None = None, located: bool = False, **where: object) -> DataFrame | None:
        """A table's rows, newest or at a version.

        ``where`` opens only files that may hold such rows, and keeps only such rows: ``since`` and ``before`` are
        UTC times, ``id`` an id, any other name a facet column of the table with the value it must have.
        """
        if self._schema(table) is None:
            return None
        files = self.files(table, version, **where)
        if files is None:
            return None
        rows = self.read_files(table, [r[0] for r in files.select("path").distinct().collect()], version, located)
        return _matching(rows, where)

    def newest(self, table: str, limit: int, version: int | None = None, **where: object) -> DataFrame:
        """The ``limit`` newest rows (ties by id) that match, opening files from the newest on until no other can matter.

        The paths and time ranges of the files that may match go to the driver.
        """
        files = (self.files(table, version, **where).groupBy("path")
                 .agg(F.count("last_at").alias("timed"), F.count("*").alias("parts"), F.max("last_at").alias("last_at"),
                      F.sum("n_rows").alias("n_rows")).collect())
        # a file with rows of unknown time stands in front
        files.sort(key=lambda f: (f["timed"] == f["parts"], f["last_at"] and -f["last_at"].timestamp(), f["path"]))
        take, need = 0, limit
        while True:
            have = sum(f["n_rows"] for f in files[:take])
            while take < len(files) and have < need:
                have += files[take]["n_rows"]
                take += 1
            rows = _matching(self.read_files(table, [f["path"] for f in files[:take]], version), where)
            rows = rows.orderBy(F.col(TIME).desc(), ID).limit(limit)
            if take == len(files):
                return rows
            least = rows.agg(F.count("*").alias("n"), F.min(TIME).alias("least")).first()
            if least["n"] == limit and least["least"] > files[take]["last_at"]:
                return rows
            need = 2 * have

    def batch_rows(self, table: str, batch_id: int) -> DataFrame:
        """The rows that a stored batch of this writer has put into a table."""
        own = (F.col(WRITER) == self.writer) & (F.col(PART) == batch_id) & (F.col("tbl") == table) & (F.col("kind") == "rows")
        return self.read_files(table, [r[0] for r in self.log().filter(own).select("path").distinct().collect()])

    def own_batch(self, table: str) -> DataFrame:
        """The rows that the batch being written has put into a table (not visible to readers yet)."""
        return self.spark.read.schema(self._schema(table)).parquet(self._folders[table]).select(*self._schema(table).names)

    # -- writing -------------------------------------------------------------
    def committed(self, batch_id: int) -> bool:
        log = self.log()
        return log is not None and not log.filter((F.col(WRITER) == self.writer) & (F.col(PART) == batch_id)).isEmpty()

    def holding(self, table: str, hashes: DataFrame) -> list[str]:
        """The files that may hold a row with one of the hashes (one column) of keys or ids."""
        files = self.files(table)
        if files is None:
            return []
        asked = hashes.distinct().limit(X.LOOKUP_HASHES + 1).toPandas().iloc[:, 0].to_numpy(np.int64)
        if len(asked) > X.LOOKUP_HASHES:
            paths = files.select("path").distinct()
        else:
            paths = X.may_hold(self._filters(files), asked)
        return [r[0] for r in paths.collect()]

    def _kept(self, rows: DataFrame) -> DataFrame:
        """``rows`` written for the time of the batch, since the lookup, the layout and the write each read them."""
        self._work = self._work or f"{self.path(WORK)}/run={uuid.uuid4().hex[:12]}"
        self._held += 1
        path = f"{self._work}/{self._held}"
        written_parquet(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _let_go(self, held: int, last: int | None = None) -> None:
        """Empty the folders of what was kept after the first ``held``, up to ``last``."""
        for n in range(held, self._held if last is None else last):
            self._clear(f"{self._work}/{n + 1}")

    def _insert_absent(self, table: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """The first row of each key that is not stored yet, computed once."""
        keys = TABLES[table]
        batch = self._kept(first_wins(rows, keys, order))
        if self._schema(table) is None:
            return batch
        paths = self.holding(table, batch.select(X.key_hash(X.row_key(keys))))
        if not paths:
            return batch
        stored = self.read_files(table, paths).select(X.row_key(keys).alias("_key"))
        new = self._kept(batch.withColumn("_key", X.row_key(keys)).join(stored, "_key", "left_anti").drop("_key"))
        self._clear(f"{self._work}/{self._held - 1}")
        return new

    def _laid_out(self, table: str, rows: DataFrame, facets: list[str], keys: list[str]) -> DataFrame:
        """Rows dealt to the files of a table by day, first facet and key; what is made of them is written as it is dealt."""
        self._dealt.add(table)
        return rows.repartitionByRange(F.to_date(TIME), *facets[:1], X.key_hash(X.row_key(keys)))

    def _write(self, table: str, df: DataFrame, batch_id: int) -> None:
        """Write rows of the batch into a new folder and note them for its log."""
        if self._schema(table) is None:
            self.spark.range(1).select(F.lit(df.schema.json())).write.mode("overwrite").text(
                self.path(f"{SCHEMAS}/{table}"))
        folder = self._folder(table, batch_id)
        keys, facets = LOOKUP.get(table, []), FACETS.get(table, [])
        names = df.columns
        if TIME in names and keys and table not in self._dealt:
            df = self._laid_out(table, df, facets, keys)
        self._dealt.discard(table)
        written_parquet(df, folder, maxRecordsPerFile=FILE_ROWS)
        self._folders[table] = folder
        written = self.spark.read.schema(self._schema(table)).parquet(folder)
        # the files are read here by as many tasks as they have splits; the commit's one task reads the facts alone
        index = folder.replace(f"{self.path(table)}/", f"{self.path(INDEX)}/{table}/", 1)
        written_parquet(X.summaries(written, [k for k in keys if k in names], [f for f in facets if f in names],
                                    TIME if TIME in names else None, ID if ID in names and keys else None), index)
        self._done.append(self.spark.read.schema(X.FACTS).parquet(index).withColumns(
            {"filters": F.lit(index), "tbl": F.lit(table), "kind": F.lit("rows")}))

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.path(table)}/{WRITER}={self.writer}/{PART}={batch_id}/run={uuid.uuid4().hex[:12]}"

    def _take_away(self, table: str, paths: DataFrame) -> None:
        """Note files (column path) that are no part of the table any more."""
        self._note(table, "gone", paths)

    def _note(self, table: str, kind: str, paths: DataFrame) -> None:
        self._done.append(paths.select("path").withColumns({"tbl": F.lit(table), "kind": F.lit(kind)}))

    def _erase(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Note located rows as replaced."""
        folder = self._folder(f"{ERASED}/{table}", batch_id)
        written_parquet(rows.select(FILE, ROW), folder)
        self._note(table, "erased", self.spark.createDataFrame([(folder,)], "path string"))

    def _commit(self, batch_id: int) -> None:
        """Write the batch's one log file, which makes it visible."""
        seq = time.time_ns() // 1000
        done = self.spark.createDataFrame([("", "commit")], "tbl string, kind string")
        for part in self._done:
            done = done.unionByName(part, allowMissingColumns=True)
        schema = StructType.fromDDL(LOG_SCHEMA)
        done = done.withColumn("seq", F.lit(seq).cast("bigint"))
        done = done.select(*[(F.col(f.name) if f.name in done.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schema], F.lit(self.writer).alias(WRITER), F.lit(batch_id).alias(PART))
        (done.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(WRITER, PART).parquet(self.path(LOG)))
        self._release()

    def _release(self) -> None:
        if self._work:
            self._clear(self._work)
        self._done, self._dealt, self._folders, self._work, self._held = [], set(), {}, None, 0

    def _clear(self, folder: str) -> None:
        """An empty overwrite removes the files wherever the store lies."""
        self.spark.createDataFrame([], "id string").coalesce(1).write.mode("overwrite").parquet(folder)

    def begin(self, batch_id: int) -> bool:
        """False if the batch is already stored; forgets what a failed attempt noted."""
        self._release()
        return not self.committed(batch_id)

    def _write_assessments(self, rows: DataFrame, batch_id: int, last_reader: bool = False) -> None:
        """New assessments with their audit and outbox rows; ``last_reader`` of all that the batch kept before.

        The three stand under one commit, so an assessment that is not stored has no stored audit or outbox row.
        """
        held = self._held
        new = self._insert_absent("assessments", rows, ["created_at"])
        if last_reader:
            self._let_go(0, held)
        self._write("assessments", new.select(*P_ASSESSMENT_COLS), batch_id)
        kept = new.filter("id IS NOT NULL")
        # dealt before their ids and envelopes are made, which are larger; to sample the ranges, all that is dealt is made too;
        # the outbox first, which has the largest shuffle
        for table, facets, made in (("outbox", [], P.outbox_rows), ("normalization_audit_log", ["source_provider"], P.audit_rows)):
            self._write(table, made(self._laid_out(table, kept, facets, ["id"])), batch_id)
        self._let_go(held)

    def write_gate_batch(self, gate: DataFrame, batch_id: int, policy: pii.PiiPolicy = pii.STRICT) -> None:
        """Persist one normalized batch: assessments, audit, outbox, failures, violations."""
        if not self.begin(batch_id):
            return
        # only failures are stored with their text
        gate = self._kept(gate.withColumn("raw", F.when(~F.col("stage").eqNullSafe(P.STAGE_OK), F.col("raw"))))
        self._write_errors(P.failed_rows(gate, policy).drop("payload_id"),
                           P.violation_rows(gate, policy).drop("payload_id"), batch_id)
        self._write_assessments(P.assessment_rows(gate), batch_id, last_reader=True)
        self._commit(batch_id)

    def write_envelope_batch(self, rows: DataFrame, batch_id: int, others: dict[str, DataFrame] | None = None) -> None:
        """Persist assessments + audit + outbox from envelope rows, and rows of plain tables, under one commit."""
        if not self.begin(batch_id):
            return
        self._write_assessments(rows, batch_id)
        for table, more in (others or {}).items():
            self._write(table, more, batch_id)
        self._commit(batch_id)

    def _write_errors(self, failed: DataFrame, violations: DataFrame, batch_id: int) -> None:
        for table, rows in (("failed_records", failed), ("schema_violations", violations)):
            held = self._held
            self._write(table, self._insert_absent(table, rows, ["created_at", "id"]), batch_id)
            self._let_go(held)

    def write_error_batch(self, failed: DataFrame, violations: DataFrame, batch_id: int) -> None:
        """Persist failed records and violations under one commit, first write wins."""
        if self.begin(batch_id):
            self._write_errors(failed, violations, batch_id)
            self._commit(batch_id)

    def write_plain_batch(self, tables: dict[str, DataFrame], batch_id: int) -> None:
        """Append rows to several plain tables under one commit."""
        if self.begin(batch_id):
            for table, rows in tables.items():
                self._write(table, rows, batch_id)
            self._commit(batch_id)

    def write_table_batch(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Append a batch to one table: a keyed one takes absent keys only, a plain one (e.g. a quarantine) all rows."""
        if self.begin(batch_id):
            self._write(table, self._insert_absent(table, rows, ["created_at"]) if table in TABLES else rows, batch_id)
            self._commit(batch_id)

    def replace_rows(self, table: str, located: DataFrame, batch_id: int) -> None:
        """Put new versions of located rows in place of the old ones (part of a batch: commits nothing)."""
        self._erase(table, located, batch_id)
        self._write(table, located.drop(FILE, ROW), batch_id)

    def vacuum(self, version: int) -> list[str]:
        """Clear the folders that no version from ``version`` on uses; returns them.

        Readers of older versions must have ended. Folder names go to the driver.
        """
        log, folder = self.log(), F.regexp_replace("path", "/[^/]+$", "")
        gone = log.filter((F.col("kind") == "gone") & (F.col("seq") <= version)).select("path")
        rows = log.filter("kind = 'rows'")
        live = rows.join(gone, "path", "left_anti").select(folder.alias("folder"))
        dead = (rows.join(gone, "path", "left_semi").select(folder.alias("folder")).distinct()
                .join(live, "folder", "left_anti"))
        cleared = [r[0] for r in dead.collect()]
        for path in cleared:
            self._clear(path)
        return cleared

    # -- outbox state --------------------------------------------------------
    def append_outbox_state(self, states: DataFrame, batch_id: int) -> None:
        """Append state events ``(assessment_id, status, retries, flushed_at)``."""
        if self.begin(batch_id):
            self.note_outbox_state(states, batch_id)
            self._commit(batch_id)

    def note_outbox_state(self, states: DataFrame, batch_id: int) -> None:
        """State events as part of a batch (commits nothing); later batches overrule earlier ones."""
        events = states.select("assessment_id", "status", "retries", "flushed_at")
        self._write("outbox_state", events.withColumn("version", F.lit(time.time_ns() // 1000)), batch_id)

    def outbox_current(self, version: int | None = None) -> DataFrame | None:
        """Outbox rows with their latest state (``max_by`` over state versions)."""
        base = self.read("outbox", version)
        return None if base is None else self.with_states(base, version)

    def with_states(self, base: DataFrame, version: int | None = None) -> DataFrame:
        """Some outbox rows with their latest state."""
        events = self.read("outbox_state", version)
        if events is None:
            return base
        latest = events.groupBy("assessment_id").agg(
            F.max_by(F.struct("status", "retries", "flushed_at"), "version").alias("s"))
        j = base.join(latest, "assessment_id", "left")
        return j.select(*[c for c in base.columns if c not in ("status", "retries", "flushed_at")],
                        F.coalesce("s.status", "status").alias("status"),
                        F.coalesce("s.retries", "retries").alias("retries"),
                        F.coalesce("s.flushed_at", "flushed_at").alias("flushed_at"))


P_ASSESSMENT_COLS = ["id", "patient_id", "assessment_date", "assessment_type", "scores", "source_provider",
                     "source_format", "ingested_at", "version", "created_at"]
