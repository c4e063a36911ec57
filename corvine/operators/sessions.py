"""Search over sessions by meaning (V7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.embed import HashingEmbedder
from corvine.functions.text import l2_normalize, session_text
from corvine.operators.vectors import searched
from corvine.session import ship
from corvine.sources import stores

_KIND = "id string, v array<double>"


def session_vectors(sessions: DataFrame, embedder: HashingEmbedder | None = None) -> DataFrame:
    """(id, v) of sessions that can be found: with an id, a text, and a vector
    with a length; the first row of an id by its text."""
    ship(sessions.sparkSession)
    text = session_text(F.col("summary"), F.col("key_files"), F.col("key_decisions"))
    some = sessions.where("id <> ''").select("id", text.alias("text")).where("text <> ''").groupBy("id").agg(F.min("text").alias("text"))
    raw = some.select("id", (embedder or HashingEmbedder()).embed(F.col("text")).alias("v"))
    return raw.withColumn("v", l2_normalize(F.col("v"))).where("v is not null")


def sessions_near(vectors: DataFrame, sessions: DataFrame | None, query: str, k: int = 5, embedder: HashingEmbedder | None = None) -> DataFrame:
    """The ``k`` nearest sessions of a text; those that the store lost are left
    out; without a store, only ids and scores."""
    q = (embedder or HashingEmbedder()).embed_text(query)
    length = sum(x * x for x in q) ** 0.5
    if not length:
        return vectors.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = searched(vectors, F.array(*[F.lit(x / length) for x in q]), k, ["id"]).select("id", "score")
    return (hits if sessions is None else hits.join(sessions, "id")).orderBy(F.desc("score"), "id")


class SessionIndex:
    """Sessions' vectors as a stored table to which sessions are added one by one."""

    def __init__(self, spark: SparkSession, folder: str, embedder: HashingEmbedder | None = None):
        self.spark, self.folder, self.embedder = spark, folder, embedder or HashingEmbedder()

    def vectors(self) -> DataFrame:
        held = stores.load(self.spark, self.folder)
        return self.spark.createDataFrame([], _KIND) if held is None else held

    def index_session(self, id: str, summary: str, key_files: list[str] | None = None, key_decisions: list[str] | None = None) -> bool:
        """False, and nothing stored, for an empty id or text, a text without a
        word, or an id that is there already."""
        row = self.spark.createDataFrame([(id, summary, key_files or [], key_decisions or [])], "id string, summary string, key_files array<string>, key_decisions array<string>")
        new, held = session_vectors(row, self.embedder).collect(), self.vectors()
        if not new or held.where(F.col("id") == id).limit(1).count():
            return False
        stores.save(held.unionByName(self.spark.createDataFrame(new, _KIND)), self.folder)
        return True

    def search(self, query: str, k: int = 5, sessions: DataFrame | None = None) -> DataFrame:
        return sessions_near(self.vectors(), sessions, query, k, self.embedder)
