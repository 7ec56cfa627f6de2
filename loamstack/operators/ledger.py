"""Processing only new or changed records: a ledger of work items (problem 4).

A work item is one content of one path at one turn: whenever a path's content differs from its last item's, the next turn
begins, so a content that comes back is work again. Its id is a digest of the three, so that a repeated or overlapping run
names the same work by the same id and its output by the same path. Items are pending, leased or done. A commit writes the
rows it changes and publishes a head that lists the files of the ledger; an item is its row of the latest commit. Of two
writers that start from the same head one fails, looks again and tries anew. A lease carries a fencing token, the number
of the commit that gave it; a worker whose lease expired and was given away holds an old token, and its completion is
rejected.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstack.io import local
from loamstack.publish import Heads, Overtaken, StaleWriter
from loamstack.session import scratch, ship

SCHEMA = "work_id string, path string, hash string, turn bigint, state string, owner string, token bigint, lease_until double, output string, seq bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
__all__ = ["Ledger", "Overtaken", "StaleWriter", "catch_up", "changed_files", "hash_value"]


class Ledger:
    """A ledger in ``folder``, which all executors must share.

    ``fold``: files beyond which a commit writes the whole ledger anew, without what no later run needs. ``retain``:
    seconds for which files that no head lists any more are kept for their readers. ``attempts``: how often a commit that
    was overtaken is tried.
    """

    def __init__(self, spark: SparkSession, folder: str, fold: int = 16, retain: float = 86_400.0, attempts: int = 8):
        ship(spark)
        self.spark, self.folder, self.fold, self.retain, self.attempts = spark, folder, fold, retain, attempts
        self.heads = Heads(spark, folder, "commit")

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        return max([0, *self.heads.numbers()])

    def _head(self, version: int | None = None) -> tuple[int, dict]:
        number, found = (version, self.heads.read(version)) if version is not None else self.heads.newest()
        return max(0, number), found or {"files": [], "leases": {}}

    def items(self, version: int | None = None) -> DataFrame:
        """The ledger as of a commit, by default the last: one row an item."""
        return self._rows(self._head(version)[1]["files"]).where("state <> 'dropped'")

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return local(self.spark, [], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{f}" for f in files))
        if len(files) == 1:
            return rows
        last = rows.groupBy("work_id").agg(F.max_by(F.struct(*_COLUMNS[1:]), "seq").alias("x"))
        return last.select("work_id", *(f"x.{c}" for c in _COLUMNS[1:]))

    def _publish(self, rows: DataFrame, version: int, lease: bool = False, head: dict | None = None) -> int:
        """Write changed rows under a name of their own, then claim the next number; a failed writer leaves no trace."""
        head = head or self._head()[1]
        number, name = version + 1, f"items-{uuid.uuid4().hex}"
        made = [name]
        rows.withColumn("seq", F.lit(number).cast("bigint")).select(*_COLUMNS).write.parquet(f"{self.folder}/{name}")
        try:
            files, leases = [*head["files"], name], dict(head["leases"])
            if lease:
                # The newest leases only: a token that is not known any more is rejected like an outdated one.
                leases = dict([*leases.items(), (str(number), self._rows([name]).where("state = 'leased'").count())][-1000:])
            if len(files) > self.fold:
                last = F.max("turn").over(Window.partitionBy("path"))
                kept = self._rows(files).where("state <> 'dropped'").withColumn("_last", last).where("state <> 'done' or turn = _last")
                name = f"items-{uuid.uuid4().hex}"
                made.append(name)
                kept.select(*_COLUMNS).write.parquet(f"{self.folder}/{name}")
                files = [name]
            self.heads.publish(number, {"files": files, "leases": leases})
        except Exception:
            for own in made:
                self.heads.remove(own)
            raise
        if len(files) == 1:
            self.vacuum()
        return number

    def vacuum(self) -> None:
        """Remove heads and files that no recent head lists and that are older than ``retain`` seconds."""
        ages = self.heads.ages()
        old = time.time() - self.retain
        numbers = self.heads.numbers()
        kept = [n for n in numbers if n == numbers[-1] or ages.get(f"commit-{n}.json", time.time()) >= old]
        used = {f for n in kept for f in (self.heads.read(n) or {"files": []})["files"]} | set(self._head()[1]["files"])
        for name, age in ages.items():
            if age < old and (name.startswith("items-") and name not in used or name.startswith("commit-") and int(name[7:-5]) < kept[0]):
                self.heads.remove(name)

    def _retried(self, attempt: Callable[[], object]):
        for left in reversed(range(self.attempts)):
            try:
                return attempt()
            except Overtaken:
                if not left:
                    raise
                time.sleep(random.random() * 0.2)  # noqa: S311

    def enqueue(self, changes: DataFrame) -> int:
        """Add (path, hash) rows as pending items, unless the path's last item has that content, in whatever state it is.

        An older content of the same path that nobody has begun is dropped: only the newest has to be processed. Of
        several contents of a path the greatest hash counts. Rows with a null path are no work. Returns the new version.
        """
        given = changes.where("path is not null").groupBy("path").agg(F.max("hash").alias("hash"))

        def attempt() -> int:
            version, head = self._head()
            known = self._rows(head["files"]).where("state <> 'dropped'")
            last = known.groupBy("path").agg(F.max_by(F.struct(*(c for c in _COLUMNS if c != "path")), "turn").alias("last"))
            met = given.join(last, "path", "left").where(F.col("last").isNull() | ~F.col("last.hash").eqNullSafe(F.col("hash")))
            turn = F.coalesce(F.col("last.turn"), F.lit(0)) + 1
            work = F.sha2(F.concat_ws("\0", "path", F.coalesce("hash", F.lit("")), turn.cast("string")), 256)
            new = F.struct(
                work.alias("work_id"), "path", "hash", turn.alias("turn"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("owner"),
                F.lit(0).cast("bigint").alias("token"), F.lit(0.0).alias("lease_until"), F.concat(F.lit("out/"), work).alias("output"), F.lit(0).cast("bigint").alias("seq"),
            )
            dropped = F.struct(*(F.lit("dropped").alias(c) if c == "state" else F.col("path") if c == "path" else F.col(f"last.{c}").alias(c) for c in _COLUMNS))
            both = F.when(F.col("last.state") == "pending", F.array(new, dropped)).otherwise(F.array(new))
            return self._publish(met.select(F.inline(both)), version, head=head)

        return self._retried(attempt)

    def lease(self, owner: str, seconds: float, now: float | None = None, shard: Column | None = None) -> tuple[int, DataFrame]:
        """Take all pending items and those whose lease has expired (of ``shard``, if given). Gives the token and the items.

        Of a path only the newest item is taken, and only once no older one is under a lease that holds; an older one
        whose lease has expired is dropped.
        """
        now = time.time() if now is None else now

        def attempt() -> int:
            version, head = self._head()
            path = Window.partitionBy("path")
            holds = (F.col("state") == "leased") & (F.col("lease_until") > now)
            open_ = self._rows(head["files"]).where("state in ('pending', 'leased')")
            seen = open_.withColumn("_last", F.max("turn").over(path)).withColumn("_held", F.max(holds).over(path))
            free = seen.where(~holds) if shard is None else seen.where(~holds & shard)
            newest = F.col("turn") == F.col("_last")
            taken = free.where(~newest | ~F.col("_held"))
            for name, value in {"owner": F.lit(owner), "token": F.lit(version + 1).cast("bigint"), "lease_until": F.lit(float(now + seconds)), "state": F.lit("leased")}.items():
                taken = taken.withColumn(name, F.when(newest, value).otherwise(F.lit("dropped") if name == "state" else F.col(name)))
            return self._publish(taken, version, lease=True, head=head)

        token = self._retried(attempt)
        return token, self.items(token).where((F.col("state") == "leased") & (F.col("token") == token))

    def complete(self, token: int, done: DataFrame | None = None) -> int:
        """Mark the items of a lease (or those of ``done``, by work_id) as done. An outdated token raises StaleWriter, also
        if only some of its items were given to another. Repeating a completion changes nothing."""
        named = done.select("work_id").distinct() if done is not None else None

        def attempt() -> int:
            version, head = self._head()
            own = self._rows(head["files"]).where((F.col("token") == token) & F.col("state").isin("leased", "done"))
            if named is None:
                lost = head["leases"].get(str(token), -1) != own.count()
            else:
                own, lost = own.join(named, "work_id", "left_semi"), not named.join(own, "work_id", "left_anti").isEmpty()
            if lost:
                raise StaleWriter(f"the lease {token} does not hold all these items any more")
            return self._publish(own.where("state = 'leased'").withColumn("state", F.lit("done")), version, head=head)

        return self._retried(attempt)


def hash_value(column: str) -> Column:
    """A hexadecimal notation as its digits: without 0x, case and leading zeros. What is no such number stays; null stays null."""
    digits = F.regexp_replace(F.lower(F.trim(F.col(column))), r"^(0x)?0*(?=[0-9a-f])", "")
    return F.when(F.trim(F.col(column)).rlike(r"^(0[xX])?[0-9a-fA-F]+$"), digits).otherwise(F.col(column))


def changed_files(scans: DataFrame, docs: DataFrame) -> DataFrame:
    """``path`` and ``hash`` value of the files whose newest readable scan differs from the store, or that it lacks.

    The newest scan of a path is the one with the greatest ``seen_at``, then ``scan_id``, among those with a hash; the
    runs' outcome does not matter, as only the store says what is done. Repeated rows count once, null paths not at all;
    a stored row with a null hash counts as changed. One partial aggregation per path, so no path is gathered in a task.
    """
    newest = (
        scans.where("path is not null and hash is not null")
        .groupBy("path")
        .agg(F.max(F.struct("seen_at", "scan_id", hash_value("hash").alias("hash"))).alias("last"))
        .select("path", F.col("last.hash").alias("hash"))
    )
    stored = docs.where("path is not null").groupBy("path").agg(F.max(F.struct(hash_value("hash").alias("h"))).alias("row")).select("path", F.col("row.h").alias("stored"))
    return newest.join(stored, "path", "left").where(~F.col("hash").eqNullSafe(F.col("stored"))).select("path", "hash")


def catch_up(
    spark: SparkSession, scans: DataFrame, docs: DataFrame, folder: str | None = None, owner: str = "catch-up",
    work: Callable[[DataFrame, int], DataFrame | None] | None = None, seconds: float = 3600, now: float | None = None,
) -> DataFrame:
    """One catch-up run over a ledger (a new one in the shared folder by default): the items it processed.

    ``work`` is called with the leased items and the token, and must have done all its work when it returns; only then is
    the lease completed. If it fails, nothing is completed, and the items are taken again once the lease has expired. It
    may give rows of its own to be returned instead of the items. By default the items are written to a list named by
    the token. Items that an earlier run completed are not taken again.
    """
    ledger = Ledger(spark, folder or scratch(spark, "ledger"))
    ledger.enqueue(changed_files(scans, docs))
    token, items = ledger.lease(owner, seconds, now)

    def listed(items: DataFrame, token: int) -> DataFrame:
        target = f"{ledger.folder}/out/lease-{token}"
        items.write.mode("overwrite").parquet(target)
        return spark.read.schema(SCHEMA).parquet(target)

    done = (work or listed)(items, token)
    version = ledger.complete(token)
    return done if done is not None else ledger.items(version).where((F.col("token") == token) & (F.col("state") == "done"))
