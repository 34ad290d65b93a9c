"""Batches of a table in an order of their own, from a cursor that outlives the run.

Each pass over the table has its own order, by a hash of key, seed and pass. Its rows are laid out once in the reader's folder,
dealt to parts by place, so that a batch reads a part or two. A batch is taken and then committed: only then the cursor
moves, to a file of its own number, so that a run that stops in between takes the same batch again, and a commit that was
cut short is no commit. Another reader on the same folder goes on where the last one was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ranking import hash_rank, numbered

#: Batches of a part, and rows of one at most: a task writes a part whole.
PART, PART_ROWS = 16, 1_000_000
LAST = ("keep", "drop", "carry")


@dataclass(frozen=True)
class Cursor:
    """The next batch's number, and the pass and place in it where it begins."""

    batch: int = 0
    turn: int = 0
    place: int = 0


class Reader:
    """last: what a pass's rest of less than a batch is: a short batch (`keep`), left out (`drop`) or the beginning of a
    batch that the next pass fills (`carry`). shuffle=False leaves all passes in the order of the key, which is unique."""

    def __init__(self, df: DataFrame, key: str, size: int, folder: str, *, seed: int = 42, last: str = "keep", shuffle: bool = True):
        if size < 1 or last not in LAST:
            raise ValueError("a batch has a row at least, and last is one of " + ", ".join(LAST))
        self.df, self.key, self.size, self.folder, self.seed, self.last, self.shuffle = df, key, size, folder, seed, last, shuffle
        self.spark: SparkSession = df.sparkSession
        self.rows = df.count()
        if not self.rows or last == "drop" and self.rows < size:
            raise ValueError("the table has no batch")
        self._columns = df.columns
        self._wide = min(size * PART, PART_ROWS)

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _laid_out(self, turn: int) -> DataFrame:
        path = f"{self.folder}/pass-{turn}-{self._wide}"
        if not self._there(f"{path}/_SUCCESS"):
            order = F.col(self.key)
            if self.shuffle:
                ranked = hash_rank(self.df, order, self.seed + turn, name="_place")
            else:
                ranked = numbered(self.df, [order], "_place")
            part = F.floor(F.col("_place") / self._wide).alias("part")
            parts = -(-self.rows // self._wide)
            ranked.select("*", part).repartitionByRange(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.parquet(path)

    def _slice(self, turn: int, low: int, high: int) -> DataFrame:
        rows, wide = self._laid_out(turn), self._wide
        return rows.where(F.col("part").between(low // wide, (high - 1) // wide) & (F.col("_place") >= low) & (F.col("_place") < high))

    def cursor(self) -> Cursor:
        """The last one that was committed."""
        path = f"{self.folder}/cursor"
        if not self._there(path):
            return Cursor()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        done = [n for n in (int(f.getPath().getName()) for f in files) if self._there(f"{path}/{n}/_SUCCESS")]
        if not done:
            return Cursor()
        row = self.spark.read.schema("batch long, turn long, place long").json(f"{path}/{max(done)}").first()
        return Cursor(row.batch, row.turn, row.place)

    def _after(self, at: Cursor) -> tuple[list[tuple[int, int, int]], Cursor]:
        """The (pass, low, high) that a batch is made of, and the cursor behind it."""
        parts, turn, place, need = [], at.turn, at.place, self.size
        while need:
            took = min(need, self.rows - place)
            parts.append((turn, place, place + took))
            place, need = place + took, need - took
            if place == self.rows or self.last == "drop" and self.rows - place < self.size:
                turn, place = turn + 1, 0
                if self.last != "carry":
                    break
        return parts, Cursor(at.batch + 1, turn, place)

    def take(self) -> tuple[DataFrame, Cursor]:
        """The next batch, in order of `batch_place`, with `batch` and `pass`; and what to commit once it has been used."""
        at = self.cursor()
        parts, after = self._after(at)
        done = 0
        out = None
        for turn, low, high in parts:
            rows = self._slice(turn, low, high).select(*self._columns, F.lit(at.batch).cast("long").alias("batch"), F.lit(turn).cast("long").alias("pass"), (F.col("_place") - low + done).alias("batch_place"))
            out, done = rows if out is None else out.unionByName(rows), done + high - low
        return out, after

    def commit(self, after: Cursor) -> None:
        row = [(after.batch, after.turn, after.place)]
        self.spark.createDataFrame(row, "batch long, turn long, place long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/cursor/{after.batch}")
