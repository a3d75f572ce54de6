"""Exactly-once intake of at-least-once queues."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.runtime import delete_path, filesystem, publish, read_text

BITS = 32768  # bits in one bitmap of Spark's bitmap functions
PARTS = 1 << 16  # write tasks that one generation may number
TRIES = 100  # generations that a writer competes for before it gives up

DICTIONARY = "ident string, shard long, code long"
BITMAPS = "space string, shard long, bucket long, bits binary"


class SeenRegistry:
    """What has been admitted so far: a dictionary of identifiers and, per space, sharded bitmaps.

    Every identifier has one exact code (no hashing of identity): the shard names the write task and generation that
    met it first, the number within the shard is dense. The dictionary only encodes; whether an identifier has been admitted
    is told by its bit alone, in the bitmaps of a space. Spaces are queues that share the identifiers but are admitted
    apart, so a known identifier may well be unseen. Bitmaps are 4 KB each, stored zstd-compressed, keyed by
    (space, shard, bucket).

    All data of a generation lie in a folder with a fresh name and count from the moment its commit file appears. The file
    is created exclusively, one per generation, so of two writers that run at once one loses, drops its data and decides
    anew on what the other has admitted. A writer that dies leaves an unused folder and nothing else. A repeated
    batch token returns the first result. After `merge_after` generations dictionary and bitmaps are merged into one.
    """

    def __init__(self, spark: SparkSession, path: str, merge_after: int = 16):
        self.spark, self.path, self.merge_after = spark, path.rstrip("/"), merge_after

    # ---- commits ---------------------------------------------------------------------------------------
    def _commits(self) -> tuple[int, list[dict]]:
        """The last generation, and the commits since the last merge, which hold all that counts."""
        fs, hadoop_path = filesystem(self.spark, self.path)
        folder = hadoop_path(f"{self.path}/commits")
        if not fs.exists(folder):
            return 0, []
        numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
        if not numbers:
            return 0, []
        last = self._commit(numbers[-1])
        return numbers[-1], [self._commit(n) for n in numbers if last["base"] <= n < numbers[-1]] + [last]

    def _commit(self, generation: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/commits/{generation:08d}"))

    def _tokens(self, commits: list[dict]) -> dict[str, str]:
        found: dict[str, str] = {}
        for c in commits:
            found |= c.get("tokens", {})
            if c["token"] is not None:
                found[c["token"]] = c["data"]
        return found

    def _publish(self, generation: int, token: str | None, data: str, base: int, **more) -> bool:
        return publish(self.spark, f"{self.path}/commits/{generation:08d}", json.dumps({"token": token, "data": data, "base": base} | more))

    # ---- contents --------------------------------------------------------------------------------------
    def _read(self, kind: str, commits: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.path}/data/{c['data']}/{kind}" for c in commits]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def dictionary(self) -> DataFrame:
        return self._read("dictionary", self._commits()[1], DICTIONARY)

    def bitmaps(self) -> DataFrame:
        """One bitmap per (space, shard, bucket): the union over all committed generations."""
        return self._union(self._commits()[1])

    def _union(self, commits: list[dict]) -> DataFrame:
        return self._read("bitmaps", commits, BITMAPS).groupBy("space", "shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def decided(self, token: str) -> DataFrame:
        """The batch's columns, `space`, `ident`, `arrivals` and `seen` of every identifier of a committed batch.

        `seen` tells that the identifier's bit was set by an earlier batch, so that it was not handed out again.
        """
        data = self._tokens(self._commits()[1])[token]
        return self.spark.read.parquet(f"{self.path}/data/{data}/decided")

    # ---- intake ----------------------------------------------------------------------------------------
    def admit(self, batch: DataFrame, ident: Column, order: list[Column], token: str, space: Column | None = None) -> DataFrame:
        """One row per identifier (and space) not admitted before: the batch's columns, `ident`, `arrivals`.

        The least arrival by `order` wins, ties are broken by all columns. Rows without identifier
        (null or '') are left out. `arrivals` counts the batch's rows with that identifier. Columns
        of the batch named `space`, `ident`, `arrivals` or `seen` are replaced. An empty batch commits nothing new.
        """
        generation, commits = self._commits()
        done = self._tokens(commits)
        if token in done:
            return self._admitted(done[token], space is not None)
        kept = [c for c in batch.columns if c not in ("space", "ident", "arrivals", "seen")]
        payload = F.struct(*[F.col(f"`{c}`") for c in kept])
        where = F.coalesce(space, F.lit("")) if space is not None else F.lit("")
        arrivals = batch.select(where.alias("space"), ident.alias("ident"), payload.alias("row"), F.struct(*order).alias("rank")).filter(
            "ident is not null and ident <> ''"
        )
        # map-side combining keeps an identifier with very many copies from loading one task
        first = arrivals.groupBy("space", "ident").agg(F.min(F.struct("rank", "row")).alias("best"), F.count(F.lit(1)).alias("arrivals"))
        draft = f"{self.path}/data/{uuid.uuid4().hex}"
        first = self._write(first.select("space", "ident", F.col("best.row").alias("row"), "arrivals"), f"{draft}/first")
        try:
            for _ in range(TRIES):
                data = uuid.uuid4().hex
                self._decide(first, commits, generation + 1, f"{self.path}/data/{data}")
                if self._publish(generation + 1, token, data, commits[-1]["base"] if commits else 0):
                    break
                delete_path(self.spark, f"{self.path}/data/{data}")
                generation, commits = self._commits()
                done = self._tokens(commits)
                if token in done:  # the other writer had the same batch
                    data = done[token]
                    break
            else:
                raise RuntimeError(f"{TRIES} generations were taken by other writers")
        finally:
            delete_path(self.spark, draft)
        if len(commits) + 1 >= self.merge_after:
            self.merge()
        return self._admitted(data, space is not None)

    def _decide(self, first: DataFrame, commits: list[dict], generation: int, path: str) -> None:
        """Write what a commit of this generation would add: new codes, decisions by bits, new bits."""
        idents = first.select("ident").distinct()
        # the batch is the side that may be small, so that the dictionary is scanned where it lies
        known = self._read("dictionary", commits, DICTIONARY).join(idents, "ident", "left_semi") if commits else None
        new = idents.join(known, "ident", "left_anti") if commits else idents
        number = F.monotonically_increasing_id()  # (task, row): stored once, so a repeated task changes nothing
        new = self._write(
            new.select("ident", (F.lit(generation) * PARTS + F.shiftright(number, 33)).alias("shard"), (number % (1 << 33)).alias("code")), f"{path}/dictionary"
        )
        place = first.join(known.unionByName(new) if commits else new, "ident").withColumns({"bucket": F.floor(F.col("code") / BITS), "bit": F.col("code") % BITS})
        if commits:
            byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
            is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
            place = place.join(self._union(commits), ["space", "shard", "bucket"], "left").withColumn("seen", F.coalesce(is_set, F.lit(False)))
        else:
            place = place.withColumn("seen", F.lit(False))  # there are no bits yet
        decided = self._write(place.select("row.*", "space", "ident", "arrivals", "seen", "shard", "bucket", "bit"), f"{path}/decided")
        unseen = decided.filter(~F.col("seen"))
        self._write(unseen.groupBy("space", "shard", "bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits")), f"{path}/bitmaps")

    def _admitted(self, data: str, with_space: bool) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/data/{data}/decided").filter(~F.col("seen")).drop("seen", "shard", "bucket", "bit")
        return rows if with_space else rows.drop("space")

    def merge(self) -> bool:
        """One dictionary and one set of bitmaps for all generations so far; False if another writer was faster."""
        generation, commits = self._commits()
        if len(commits) < 2:
            return False
        data = uuid.uuid4().hex
        self._write(self._read("dictionary", commits, DICTIONARY), f"{self.path}/data/{data}/dictionary")
        self._write(self._union(commits), f"{self.path}/data/{data}/bitmaps")
        if self._publish(generation + 1, None, data, generation + 1, tokens=self._tokens(commits)):
            return True
        delete_path(self.spark, f"{self.path}/data/{data}")
        return False

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
