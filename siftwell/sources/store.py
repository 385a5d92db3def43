"""The commit log: append-only Parquet, live views, time travel, rotating snapshots, and the engine over them.

A commit is (commit_id, op, doc_id, data, max_depth, ts). Nothing is changed in place: the
live documents are those whose last commit adds them, and a state of the past is the same over
the commits up to then. One writer at a time; readers see whole appends.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.collection import DEFAULT, Collection, TokenizerConfig
from siftwell.operators.flatten import invalid_keys, valid_json

SCHEMA = "commit_id long, op string, doc_id string, data string, max_depth int, ts timestamp"
#: A snapshot is written once so many commits have come, into this many slots in turn.
SNAPSHOT_EVERY, SNAPSHOT_SLOTS = 100, 3


def live(commits: DataFrame, up_to: int | None = None) -> DataFrame:
    """The last commit of each document, where it adds it; with ``up_to``, as things stood after that commit.

    One shuffle on doc_id, combined on the map side: a task sends a document's latest commit only.
    """
    if up_to is not None:
        commits = commits.where(F.col("commit_id") <= up_to)
    rest = [c for c in commits.columns if c not in ("doc_id", "commit_id")]
    last = commits.groupBy("doc_id").agg(F.max("commit_id").alias("commit_id"), F.max_by(F.struct(*rest), "commit_id").alias("last"))
    return last.where(F.col("last.op") == "add").select("doc_id", "commit_id", *[F.col(f"last.{c}").alias(c) for c in rest])


def replay(snapshot: DataFrame, commits: DataFrame, at: int) -> DataFrame:
    """The live documents from those of a snapshot taken after commit ``at`` and the later commits alone."""
    return live(snapshot.unionByName(commits.where(F.col("commit_id") > at), allowMissingColumns=True))


def _unnamed(kind: T.DataType) -> bool:
    """Whether a type has a field without a name."""
    if isinstance(kind, T.StructType):
        return any(not f.name or _unnamed(f.dataType) for f in kind)
    return _unnamed(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType) and _unnamed(kind.valueType)


class Engine:
    """Documents in a folder: ``commits`` and ``snapshots``. Opening reads nothing but file lists."""

    def __init__(self, spark: SparkSession, path: str | None = None, config: TokenizerConfig = DEFAULT, snapshot_every: int = SNAPSHOT_EVERY, slots: int = SNAPSHOT_SLOTS):
        self.spark, self.config, self.snapshot_every, self.slots = spark, config, snapshot_every, slots
        self.path = (path or os.environ.get("INDEX_DIR") or "data/siftwell").rstrip("/")
        self.log_path = os.environ.get("COMMIT_DIR") if path is None and os.environ.get("COMMIT_DIR") else f"{self.path}/commits"
        self.snapshot_path = os.environ.get("SNAPSHOTS_DIR") if path is None and os.environ.get("SNAPSHOTS_DIR") else f"{self.path}/snapshots"

    # --- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _pointers(self) -> list[str]:
        """Names of the pointers to snapshots, oldest first."""
        fs, p = self._fs(self.snapshot_path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("meta-")) if fs.exists(p) else []

    def _meta(self) -> dict | None:
        """The newest snapshot's slot and commit, or None; unreadable pointers count as none."""
        for name in reversed(self._pointers()):
            try:
                return json.loads("".join(r.value for r in self.spark.read.text(f"{self.snapshot_path}/{name}").collect()))
            except ValueError:
                continue
        return None

    def _set_meta(self, meta: dict) -> None:
        """A new pointer appears by a rename, after the slot is whole; older ones go only then."""
        fs, tmp = self._fs(f"{self.snapshot_path}/.meta-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        old = self._pointers()
        number = int(old[-1][5:25]) + 1 if old else 0
        _, to = self._fs(f"{self.snapshot_path}/meta-{number:020d}.json")
        if not fs.rename(tmp, to):
            raise OSError(f"can't write {to}")
        for name in old:
            fs.delete(self._fs(f"{self.snapshot_path}/{name}")[1], False)

    # --- log

    @property
    def commits(self) -> DataFrame:
        if not self.exists(self.log_path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.log_path)

    def last_commit_id(self) -> int:
        return self.commits.agg(F.max("commit_id")).first()[0] or 0

    def _append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.log_path)

    def _log(self, rows: Iterable[tuple[str, str, str | None, int | None]]) -> int:
        last = self.last_commit_id()
        rows = [(last + 1 + i, *r) for i, r in enumerate(rows)]
        if rows:
            df = self.spark.createDataFrame(rows, "commit_id long, op string, doc_id string, data string, max_depth int")
            self._append(df.withColumn("ts", F.current_timestamp()).coalesce(1))
            self._maybe_snapshot(last, last + len(rows))
        return last + len(rows)

    def add(self, *docs: dict, ids: list[str] | None = None, max_depth: int | None = None) -> list[str]:
        """Commits documents and gives their ids (new ones unless given). An id that exists is replaced."""
        for d in docs:
            if not isinstance(d, dict):
                raise ValueError("a document is an object")
            if invalid_keys(d):
                raise ValueError("empty field name")
        ids = ids if ids is not None else [uuid.uuid4().hex[:16] for _ in docs]
        self._log([("add", i, json.dumps(d, ensure_ascii=False), max_depth) for i, d in zip(ids, docs, strict=True)])
        return ids

    def update(self, doc_id: str, doc: dict, max_depth: int | None = None) -> None:
        """A whole new version: the later commit counts."""
        self.add(doc, ids=[doc_id], max_depth=max_depth)

    def add_file(self, path: str, max_depth: int | None = None) -> list[str]:
        """One JSON file: an object is a document, an array one for each of its objects (other items are skipped)."""
        whole = self.spark.read.text(path, wholetext=True).first()
        if whole is None:
            raise ValueError(f"{path} is empty")
        value = json.loads(whole.value)
        if not isinstance(value, (dict, list)):
            raise ValueError("the file must hold an object or an array")
        return self.add(*([value] if isinstance(value, dict) else [v for v in value if isinstance(v, dict)]), max_depth=max_depth)

    def add_table(self, df: DataFrame, id_col: str | None = None, max_depth: int | None = None) -> int:
        """Commits each row of a table as a document, without passing the driver; commit ids grow, with gaps."""
        if _unnamed(df.schema):
            raise ValueError("empty field name")
        last = self.last_commit_id()
        cols = [c for c in df.columns if c != id_col]
        out = df.select(
            (F.lit(last + 1) + F.monotonically_increasing_id()).alias("commit_id"), F.lit("add").alias("op"),
            (df[f"`{id_col}`"].cast("string") if id_col else F.uuid()).alias("doc_id"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("data"), F.lit(max_depth).cast("int").alias("max_depth"), F.current_timestamp().alias("ts"),
        )
        self._append(out)
        return self._noted(last)

    def add_json_lines(self, path: str, max_depth: int | None = None) -> int:
        """Commits each line of files of JSON objects; distributed, like ``add_table``.

        Lines that are no JSON object, or have an empty field name, are left out, as other items of a file are.
        """
        last = self.last_commit_id()
        lines = self.spark.read.text(path).where(valid_json("value"))
        self._append(lines.select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("commit_id"), F.lit("add").alias("op"), F.uuid().alias("doc_id"), F.col("value").alias("data"), F.lit(max_depth).cast("int").alias("max_depth"), F.current_timestamp().alias("ts")))
        return self._noted(last)

    def delete(self, *ids: str) -> None:
        """Commits deletions; ids that aren't there are no error."""
        self._log([("delete", i, None, None) for i in ids])

    # --- states

    def live(self) -> DataFrame:
        """The documents as they stand, from the newest snapshot and the commits after it."""
        meta = self._meta()
        at = f"{self.snapshot_path}/slot={meta['slot']}" if meta else ""
        if not meta or not self.exists(at):
            return live(self.commits)
        return replay(self.spark.read.schema(SCHEMA).parquet(at), self.commits, meta["commit_id"])

    def as_of(self, commit_id: int) -> DataFrame:
        """The documents as they stood after a commit; nothing changes."""
        return live(self.commits, commit_id)

    def rollback_to(self, commit_id: int) -> int:
        """New commits that bring that state back; the log keeps everything."""
        now = self.live().select("doc_id", F.struct("data", "max_depth").alias("now"))
        then = self.as_of(commit_id).select("doc_id", F.struct("data", "max_depth").alias("old"))
        both = now.join(then, "doc_id", "full_outer").where(~F.col("now").eqNullSafe(F.col("old")))
        last = self.last_commit_id()
        self._append(both.select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("commit_id"), F.when(F.col("old").isNull(), "delete").otherwise("add").alias("op"), "doc_id", "old.data", "old.max_depth", F.current_timestamp().alias("ts")))
        return self._noted(last)

    def _noted(self, before: int) -> int:
        """The last commit id after a write that began at ``before``; a snapshot if it is time for one."""
        now = self.last_commit_id()
        self._maybe_snapshot(before, now)
        return now

    def _maybe_snapshot(self, before: int, now: int) -> None:
        if now // self.snapshot_every > before // self.snapshot_every:
            self.snapshot()

    def snapshot(self) -> int:
        """Writes the live documents into the next slot, then moves the pointer. Gives the slot."""
        meta = self._meta() or {"slot": 0}
        slot, at = meta["slot"] % self.slots + 1, self.last_commit_id()
        self.live().select([c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.snapshot_path}/slot={slot}")
        self._set_meta({"slot": slot, "commit_id": at})
        return slot

    def close(self) -> None:
        """Nothing is held back: every commit is on disk already."""

    # --- queries

    def collection(self, commit_id: int | None = None, date_paths: tuple[str, ...] = ()) -> Collection:
        """The operators over the live documents, or those after a commit. A commit's max_depth cuts its document."""
        docs = self.live() if commit_id is None else self.as_of(commit_id)
        c = Collection.from_json(docs, "doc_id", "data", self.config, date_paths=date_paths)
        limits = docs.where("max_depth is not null").select("doc_id", "max_depth")
        if limits.isEmpty():
            return c
        some = c.base.join(limits, "doc_id", "left")
        cut = F.filter("leaves", lambda x: F.col("max_depth").isNull() | (x["depth"] <= F.col("max_depth")))
        return Collection(some.select("doc_id", cut.alias("leaves")), self.config)

    def get(self, doc_id: str) -> DataFrame:
        return self.live().where(F.col("doc_id") == doc_id)

    def query(self, text: str) -> DataFrame:
        return self.collection().query(text)

    def stats(self) -> DataFrame:
        return self.collection().stats()
